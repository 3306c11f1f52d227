"""Hard negatives of anchors by an inverted multi-index.

A vector's components are made whole numbers, and its two halves are assigned to
the nearest words of two codebooks; a cell is a pair of words. Each word has a
radius, the farthest that any vector of it lies away, over all vectors and not over
the sample that the books are learnt from. An anchor's inner product with anything
in a cell is then at most the sum of two half bounds, each the product with a word
plus radius times length. A heap visits cells by falling sums and stops where the
next bound is below what the anchor's windows still take: no vector beyond can
count. What it visited is searched exactly, in whole numbers.

An anchor's positives are the best of its own label; a sample that every task has
gives a score that they reach at least, so the first search stops there. Each
positive's score then gives a window for negatives, and the second search stops
below the lowest window.

Cells are dealt to blocks of bounded size, large cells to several; an anchor goes
only to blocks that hold a visited cell, in groups of bounded size. A block sends
out the best of each anchor's windows, not its pairs.

Edge cases: rows with a null id, label or vector, an empty vector, or a null or
non-finite component, or one of 2**16 or more in size (its products might not fit a
long), take no part; vectors of different lengths are no partners; of several rows under one vec_id the
one with the least label and vector counts; an anchor without positives, and a
positive with a score below 0, has no negatives; other columns are ignored; an
empty table gives an empty result. Lengths beyond the ``LENGTHS`` commonest, or
with too few vectors to learn from, are one cell and searched whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as c

POSITIVES, NEGATIVES, EVERY = 5, 5, 100
#: A negative's score as a percentage of the positive's, least and most.
LEAST, MOST = 80, 100
#: Vectors that codebooks are learnt from, lengths that have their own, words of a book, vectors for each word.
SAMPLE, LENGTHS, WORDS, ENOUGH = 8192, 16, 32, 8
#: Vectors of a block, least and most; blocks aimed at between them; anchors that one task takes with a block.
FEW, MANY, BLOCKS, GROUP = 512, 65_536, 256, 16_384
#: Components are smaller than this.
SIZE = 2**16
#: Rows that an anchor's routes are sent on in, at least; elements of one table of scores.
_ROUTES = 1 << 14
_STEP = 1 << 21


def floats(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exactly: as doubles where those hold them all."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (floats(a) @ floats(b).T).astype(np.int64)
    return a @ b.T


def learn_words(x: np.ndarray, words: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centres of x by alternating assignment and means."""
    words = max(1, min(words, len(x) // ENOUGH))
    centres = x[np.random.default_rng(seed).permutation(len(x))[:words]]
    for _ in range(rounds):
        own = nearest(x, centres)[0]
        size = np.bincount(own, minlength=words)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and how far away it is."""
    own = ((centres**2).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)
    return own, np.sqrt(((x - centres[own]) ** 2).sum(1))


@dataclass
class Books:
    """Two codebooks of one length, and radii of their words over all vectors."""

    words: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def learn(cls, x: np.ndarray) -> Books:
        half = x.shape[1] // 2
        return cls(tuple(learn_words(part, WORDS) for part in (x[:, :half], x[:, half:])))

    @classmethod
    def single(cls, width: int) -> Books:
        half = width // 2
        return cls((np.zeros((1, half)), np.zeros((1, width - half))))

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.words[0].shape[1]
        return x[:, :half], x[:, half:]

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor and word the most that a half product can be, a little above for rounding's sake."""
        out = []
        for part, words, radii in zip(self.halves(a), self.words, self.radii):
            length = np.sqrt((part**2).sum(1))
            reach = np.sqrt((words**2).sum(1)) + radii
            out.append(part @ words.T + length[:, None] * radii[None, :] + 1e-9 * length[:, None] * reach[None, :] + 1e-6)
        return out[0], out[1]


def multi_sequence(first: np.ndarray, second: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """Cells (i, j) by falling first[i] + second[j], down to ``least``."""
    i_order, j_order = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    a, b = first[i_order].tolist(), second[j_order].tolist()
    heap = [(-(a[0] + b[0]), 0, 0)]
    while heap and -heap[0][0] >= least:
        _, i, j = heapq.heappop(heap)
        yield int(i_order[i]), int(j_order[j])
        if j + 1 < len(b):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if not j and i + 1 < len(a):
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, q): the rows that take part, with whole components."""
    v = F.col("embedding")
    size = lambda x: F.abs(x.cast("double"))
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (size(x) < float(SIZE)))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    q = F.transform(v, lambda x: F.floor(x.cast("double") * 256).cast("int"))
    one = rows.select("vec_id", F.struct(label.alias("label"), q.alias("q")).alias("r")).groupBy("vec_id").agg(F.min("r").alias("r"))
    return c.materialize(one.select("vec_id", "r.*").withColumn("width", F.size("q")), "whole-vectors")


def _matrix(column) -> np.ndarray:
    """A list column of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.list_flatten(column).to_numpy().astype(np.int64).reshape(len(column), -1)


def _by_width(batch):
    """Each length and its rows."""
    width = batch.column("width").to_numpy()
    for w in np.unique(width).tolist():
        yield w, batch.take(pa.array(np.flatnonzero(width == w)))


class Search:
    """An index of whole vectors in the shared folder, and exact searches of it."""

    def __init__(self, vectors: DataFrame):
        self.spark = vectors.sparkSession
        self.width = "vec_id long, label long, q array<int>, width int"
        widths = vectors.groupBy("width").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").limit(LENGTHS).collect()
        books, samples = {}, {}
        for row in widths:
            rows = vectors.filter(F.col("width") == row["width"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
            samples[row["width"]] = (rows["vec_id"].to_numpy(), rows["label"].to_numpy(), _matrix(rows["q"]))
            books[row["width"]] = Books.learn(floats(samples[row["width"]][2]))
        self.samples = self.spark.sparkContext.broadcast(samples)  # LENGTHS times SAMPLE vectors at most
        self._assign(vectors, books)

    def _assign(self, vectors: DataFrame, books: dict[int, Books]) -> None:
        shared = self.spark.sparkContext.broadcast(books)

        def cells(batches):
            for batch in batches:
                for w, part in _by_width(batch):
                    own = shared.value.get(w) or Books.single(w)
                    x = floats(_matrix(part.column("q")))
                    (i, di), (j, dj) = (nearest(h, words) for h, words in zip(own.halves(x), own.words))
                    columns = [part.column(k) for k in ("vec_id", "label", "q", "width")]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(di), pa.array(dj)], ["vec_id", "label", "q", "width", "i", "j", "di", "dj"])

        assigned = c.materialize(vectors.mapInArrow(cells, f"{self.width}, i int, j int, di double, dj double"), "cells")
        known = F.when(F.col("width").isin(list(books)), F.col("width")).otherwise(-1)  # the rest, of any length, share a cell
        found = assigned.groupBy(known.alias("book"), "i", "j").agg(F.count("*").alias("n"), F.max("di").alias("di"), F.max("dj").alias("dj")).collect()  # LENGTHS times WORDS**2 at most
        n = sum(r["n"] for r in found)
        size = min(MANY, max(FEW, n // BLOCKS))
        place, block, room = {}, -1, 0
        for r in sorted(found, key=lambda r: (r["book"], r["i"], r["j"])):
            if r["n"] > room:
                block, room = block + 1, size
            parts = -(-r["n"] // size)
            place[r["book"], r["i"], r["j"]] = (block, parts)
            block, room = (block, room - r["n"]) if parts == 1 else (block + parts - 1, 0)
        for w, b in books.items():
            b.radii = tuple(np.array([max((r[k] for r in found if r["book"] == w and r[axis] == m), default=0.0) for m in range(len(words))]) for k, axis, words in (("di", "i", b.words[0]), ("dj", "j", b.words[1])))
        self.books, self.place = self.spark.sparkContext.broadcast(books), self.spark.sparkContext.broadcast(place)
        table = self.spark.createDataFrame([(*k, *v) for k, v in place.items()], "book int, i int, j int, first int, parts int")
        dealt = assigned.drop("di", "dj").withColumn("book", known).join(F.broadcast(table), ["book", "i", "j"])
        self.rows = dealt.select("vec_id", "label", "q", "width", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int").alias("block"))

    def routed(self, anchors: DataFrame, floor: str | None) -> DataFrame:
        """Anchors once for each block that may hold a vector of score ``floor`` or more; without a floor, what the sample guarantees."""
        books, place, samples = self.books, self.place, self.samples

        def visits(batch, q, least, w):
            """The blocks of each row of one length, by the cells that its heap visits."""
            own = books.value.get(w)
            if own is None:
                first, parts = place.value[-1, 0, 0]
                yield from (range(first, first + parts) for _ in range(len(batch)))
                return
            one, two = own.bounds(floats(q))
            for k in range(len(batch)):
                seen = set()
                for cell in multi_sequence(one[k], two[k], float(least[k])):
                    first, parts = place.value.get((w, *cell), (0, 0))
                    seen.update(range(first, first + parts))
                yield sorted(seen)

        def sent(batch, rows, blocks, least):
            taken = batch.take(pa.array(np.repeat(rows, [len(x) for x in blocks])))
            names = [n for n in taken.schema.names if n not in ("block", "least")]
            block = np.concatenate([np.array(x, np.int32) for x in blocks])
            floors = np.repeat(least[rows], [len(x) for x in blocks])
            return pa.RecordBatch.from_arrays([*(taken.column(n) for n in names), pa.array(block), pa.array(floors)], [*names, "block", "least"])

        def run(batches):
            for whole in batches:
                for w, batch in _by_width(whole):
                    q = _matrix(batch.column("q"))
                    least = batch.column(floor).to_numpy() if floor else _guaranteed(samples.value.get(w), batch, q)
                    rows, blocks, n = [], [], 0
                    for k, found in enumerate(visits(batch, q, least, w)):
                        rows.append(k)
                        blocks.append(found)
                        n += len(found)
                        if n >= _ROUTES or k + 1 == len(batch):
                            yield sent(batch, rows, blocks, least)
                            rows, blocks, n = [], [], 0

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema if f.name != "least")
        return anchors.mapInArrow(run, f"{kinds}, block int, least long")

    def best(self, anchors: DataFrame, groups: int, same: bool, k: int, floor: str | None = None) -> DataFrame:
        """(anchor_id, high, vec_id, score): the ``k`` best of each anchor's windows, out of rows of its own label (``same``) or of all others.

        ``anchors``: vec_id, label, q, width, grp, and ``highs``, the windows' upper ends; the lower ones are LEAST per
        cent of them. A null among ``highs`` is a window without ends.
        """
        routed = self.routed(anchors, floor)
        every = self.rows.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))) if groups > 1 else self.rows.withColumn("grp", F.lit(0))

        def search(left, right):
            out = []
            if left.num_rows and right.num_rows:
                for w, mine in _by_width(left):
                    on = right.filter(pc.equal(right["width"], w))
                    if on.num_rows:
                        out += _scores(mine, on, same, k)
            columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
            ids, highs, found, scores = columns
            return pa.Table.from_arrays([pa.array(ids), pa.array(highs, mask=highs < 0), pa.array(found), pa.array(scores)], ["anchor_id", "high", "vec_id", "score"])

        met = routed.groupBy("block", "grp").cogroup(every.groupBy("block", "grp")).applyInArrow(search, "anchor_id long, high long, vec_id long, score long")
        order = Window.partitionBy("anchor_id", "high").orderBy(F.desc("score"), "vec_id")
        return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _guaranteed(sample, part, q: np.ndarray) -> np.ndarray:
    """A score that each anchor's positives all reach, as so many rows of the sample do."""
    least = np.full(len(q), -(2**63), np.int64)
    if sample is None:
        return least
    ids, labels, x = sample
    step = max(1, _STEP // max(1, len(x)))
    for at in range(0, len(q), step):
        scores = products(q[at : at + step], x)
        mine = (part.column("label").to_numpy()[at : at + step, None] == labels[None, :]) & (part.column("vec_id").to_numpy()[at : at + step, None] != ids[None, :])
        for k in np.flatnonzero(mine.sum(1) >= POSITIVES).tolist():
            own = scores[k][mine[k]]
            least[at + k] = np.partition(own, len(own) - POSITIVES)[len(own) - POSITIVES]
    return least


def _scores(anchors: pa.Table, rows: pa.Table, same: bool, k: int) -> list[tuple[np.ndarray, ...]]:
    """For each anchor and window the best rows of a block: anchor ids, windows' ends (-1: none), row ids, scores."""
    ids, labels, x = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), _matrix(rows["q"])
    order = np.argsort(ids, kind="stable")
    ids, labels, x = ids[order], labels[order], x[order]  # ties go to smaller ids
    who, own, q = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy(), _matrix(anchors["q"])
    least, highs = anchors["least"].to_numpy(), anchors["highs"].to_pylist()
    out, step = [], max(1, _STEP // max(1, len(x)))
    for at in range(0, len(q), step):
        scores = products(q[at : at + step], x)
        fits = ((own[at : at + step, None] == labels[None, :]) == same) & (who[at : at + step, None] != ids[None, :]) & (scores >= least[at : at + step, None])
        for i in np.flatnonzero(fits.any(1)).tolist():
            some = np.flatnonzero(fits[i])
            some = some[np.argsort(-scores[i, some], kind="stable")]
            value = scores[i, some]
            for high in highs[at + i]:
                first = 0 if high is None else int(np.searchsorted(-value, -high, side="left"))
                last = len(value) if high is None else int(np.searchsorted(-value, -_low(high), side="right"))
                picked = some[first : min(last, first + k)]
                n = len(picked)
                out.append((np.full(n, who[at + i]), np.full(n, -1 if high is None else high, np.int64), ids[picked], scores[i, picked]))
    return out


def _low(high: int) -> int:
    """The least whole score that is LEAST per cent of ``high`` or more."""
    return -(-LEAST * high // MOST)


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for every anchor and positive."""
    c.small_batches(vectors.sparkSession)
    rows = prepared(vectors)
    search = Search(rows)
    anchors = rows.filter(F.col("vec_id") % EVERY == 0)
    groups = max(1, -(-anchors.count() // GROUP))
    anchors = anchors.withColumn("grp", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
    anyhow = F.array(F.lit(None).cast("long"))
    positives = search.best(anchors.withColumn("highs", anyhow), groups, True, POSITIVES)
    positives = c.materialize(positives.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).filter("positive_score >= 0"), "positives")
    ends = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_set("positive_score"), False).alias("highs"))  # POSITIVES at most
    lowest = F.expr(f"({LEAST} * array_min(highs) + {MOST - 1}) div {MOST}")
    asked = anchors.join(ends, "vec_id").withColumn("least", lowest)
    found = search.best(asked, groups, False, NEGATIVES, "least")
    found = found.select("anchor_id", F.col("high").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positives.join(found, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")


def op12_multi_index_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op12_multi_index_negatives": op12_multi_index_negatives}

_SQL = f"""WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
met AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, cast(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM rows a JOIN rows b ON a.vec_id % {EVERY} = 0 AND b.vec_id <> a.vec_id AND len(a.q) = len(b.q)),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS rn FROM met WHERE same) WHERE rn <= {POSITIVES})
SELECT anchor_id, positive_id, cast(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
 SELECT p.*, n.vec_id AS negative_id, n.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS rank
 FROM pos p JOIN met n ON n.anchor_id = p.anchor_id AND NOT n.same AND {LEAST}*p.positive_score <= {MOST}*n.score AND {MOST}*n.score <= {MOST}*p.positive_score) WHERE rank <= {NEGATIVES}"""

ORACLES = {"op12_multi_index_negatives": _SQL}
