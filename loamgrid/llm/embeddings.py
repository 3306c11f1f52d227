"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Rotations of the principal axes are learnt on a bounded sample so that the signs
of the rotated vectors make balanced binary codes. A code is cut into substrings,
one table for each, in which vectors of a label that agree meet. There the codes
are compared, and only vectors with a code near enough go on: with them the
original vectors are fetched and compared in double precision. A pair counts in
the first table in which it meets. Tasks send out link counts and spanning edges,
never pairs.

Substrings grow with the logarithm of a label's vectors, so that buckets stay as
full as they are, and tables grow in number to make up for it: what is compared
with a vector grows far slower than the label. How many tables there are follows
from the share of bits in which vectors at the threshold differ, measured on the
sample, so that at most ``MISS`` of such pairs meet in no table. Codes longer
than the vectors come from several rotations. Buckets that stay large, as of a
family of near copies, are dealt into blocks.

Edge cases: vectors of different lengths never link; equal vectors of a label are
compared once and counted as often as they occur; rows that share a vec_id but not
label and vector are vectors of their own, and each row of that id tells its own
links and component; a vector that is null, empty, zero, or holds null or
non-finite components, or has no label or id, links with nothing; the commonest lengths get learnt rotations, all others random ones;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import acos, ceil, log, pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c
from .components import components

THRESHOLD = 0.93
#: Vectors of a length that its rotations are learnt from, at most, and lengths that learn their own.
SAMPLE, LENGTHS = 8192, 16
#: Vectors of a length below which its directions are random.
ENOUGH = 256
#: Members of a bucket that one task compares with one another; vectors of a bucket aimed at.
BLOCK, FULL = 1024, 32
#: Bits of a substring, least and most; buckets that one task takes together.
LEAST, MOST, TOGETHER = 8, 24, 256
#: Share of pairs at the threshold that may meet in no table.
MISS = 0.01
#: Elements of one comparison step.
_STEP = 1 << 21


def learn_rotation(x: np.ndarray, bits: int, rounds: int = 40, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dims x bits) whose signs lose least, by alternating codes and Procrustes rotations.

    Where most vectors lie close together nothing is taken off: what is left of
    near copies would point anywhere.
    """
    mean = x.mean(0)
    if np.linalg.norm(mean) > 0.5:
        mean = np.zeros_like(mean)
    values, axes = np.linalg.eigh((x - mean).T @ (x - mean) / len(x) + 1e-9 * np.eye(x.shape[1]))
    axes = axes[:, np.argsort(-values)[:bits]]
    if axes.shape[1] < bits:
        axes = np.pad(axes, ((0, 0), (0, bits - axes.shape[1])))
    v = (x - mean) @ axes
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
        r = (u @ w).T
    return mean, axes @ r


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Codes:
    """Signs of rotated vectors of one length; ``flip`` is the share of bits in which a pair at the threshold differs, ``far`` the most that one may."""

    mean: np.ndarray
    projection: np.ndarray
    flip: float
    far: float

    @classmethod
    def learn(cls, x: np.ndarray, bits: int, threshold: float) -> Codes:
        """From unit vectors ``x``: as many rotations as ``bits`` take, each from a start of its own."""
        each = min(max(LEAST, x.shape[1]), bits)
        parts = [learn_rotation(x, each, seed=11 + k) for k in range(-(-bits // each))]
        made = cls(parts[0][0], np.concatenate([p for _, p in parts], 1)[:, :bits], acos(threshold) / pi, 1.0)
        away = np.random.default_rng(3).normal(size=x.shape)
        away -= (away * x).sum(1, keepdims=True) * x
        other = threshold * x + (1 - threshold**2) ** 0.5 * away / np.maximum(1e-12, np.linalg.norm(away, axis=1, keepdims=True))
        share = (made.bits(x) != made.bits(other)).mean(1)
        made.flip = min(0.45, max(made.flip, float(share.mean())))
        made.far = float(share.mean() + 6 * share.std())
        return made

    @classmethod
    def draw(cls, width: int, bits: int, threshold: float) -> Codes:
        """Random directions, for lengths that learn none."""
        projection = np.random.default_rng(width).normal(size=(width, bits))
        return cls(np.zeros(width), projection, acos(threshold) / pi, 1.0)

    def bits(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.projection > 0


def substring_bits(n: int) -> int:
    """Bits of a substring for a label of n vectors."""
    return min(MOST, max(LEAST, ceil(log(max(1, n / FULL), 2))))


def tables(flip: float, bits: int) -> int:
    """Tables that leave out at most MISS of the pairs at the threshold."""
    return ceil(log(MISS) / log(1 - (1 - flip) ** bits))


def usable() -> Column:
    """Whether a row's vector can link: finite, not zero, with label and id."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))


def learn(classes: DataFrame, threshold: float, sample: int) -> dict[int, Codes]:
    """Codes for the commonest lengths of ``classes`` (id, embedding, size, width)."""
    widths = classes.groupBy("width").agg(F.count("*").alias("n"), F.max("size").alias("most")).orderBy(F.desc("n"), "width").limit(LENGTHS).collect()
    out = {}
    for row in widths:
        rows = classes.filter(F.col("width") == row["width"]).orderBy(F.xxhash64("label", "embedding"), "label", "embedding").select("embedding").limit(sample).toArrow()
        x = _unit(rows.column(0).combine_chunks().flatten().to_numpy().reshape(-1, row["width"]))
        if len(x) < ENOUGH:
            continue
        wanted = substring_bits(row["most"])
        guess = Codes.learn(x, max(LEAST, min(x.shape[1], 64)), threshold).flip
        bits, found = wanted * tables(min(0.45, guess * 1.05), wanted), None
        while found is None or bits < wanted * tables(found.flip, wanted):  # codes of that length lose more than was guessed: longer ones
            bits = bits if found is None else wanted * tables(min(0.45, found.flip * 1.05), wanted)
            found = Codes.learn(x, bits, threshold)
        out[row["width"]] = found
    return out


def _buckets(keys: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of each key that several share."""
    order = np.argsort(keys, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(keys[order])) + 1, len(keys))
    for start, stop in zip([0, *ends.tolist()], ends.tolist()):
        if stop - start > 1:
            yield order[start:stop]


def _open(codes: np.ndarray, own: np.ndarray, rows: slice, tab: int, same_block: bool) -> np.ndarray:
    """Pairs (rows x all) that meet here first: in no earlier table, and in no other pair of blocks."""
    fresh = np.ones((len(codes[rows]), len(codes)), bool)
    for t in range(tab):
        fresh &= codes[rows, t][:, None] != codes[:, t][None, :]
    if not same_block:
        fresh &= own[rows][:, None] != own[None, :]
    at = np.arange(len(codes))[rows]
    fresh[np.arange(len(at)), at] = False
    return fresh


def link(classes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(a, b, n) for distinct vectors (id, m, label, embedding): n links more for a (b null), or an edge a-b (n = 0)."""
    spark = classes.sparkSession
    classes = classes.withColumn("width", F.size("embedding"))
    sizes = classes.groupBy("label", "width").agg(F.count("*").alias("size"))
    classes = classes.join(sizes.filter("size > 1"), ["label", "width"])
    learnt = spark.sparkContext.broadcast(learn(classes, threshold, sample))  # LENGTHS of them at most

    def codes_for(width: int, bits: int, drawn: dict = {}) -> tuple[Codes, int]:  # noqa: B006
        found = learnt.value.get(width)
        if found is not None and found.projection.shape[1] >= bits * tables(found.flip, bits):
            return found, tables(found.flip, bits)
        m = tables(acos(threshold) / pi, bits)
        if (width, bits) not in drawn:
            drawn[width, bits] = Codes.draw(width, bits * m, threshold)
        return drawn[width, bits], m

    names = ["label", "width", "bits", "tab", "key", "id", "code"]

    def index(batches):
        for batch in batches:
            shape = np.stack([batch.column("width").to_numpy(), batch.column("size").to_numpy()], 1).astype(np.int64).reshape(-1, 2)
            bits = np.array([substring_bits(n) for n in shape[:, 1].tolist()], np.int64)
            for width, b in {(w, k) for w, k in zip(shape[:, 0].tolist(), bits.tolist())}:
                rows = pa.array(np.flatnonzero((shape[:, 0] == width) & (bits == b)))
                part = batch.take(rows)
                codes, m = codes_for(width, b)
                x = _unit(part.column("embedding").flatten().to_numpy().reshape(-1, width))
                cut = codes.bits(x)[:, : m * b].reshape(len(x), m, b)
                keys = (cut * (1 << np.arange(b))).sum(2)
                packed = pa.array([k.tobytes() for k in keys.astype("<u4")], pa.binary())
                for t in range(m):
                    columns = [part.column("label"), part.column("width"), *(pa.array(np.full(len(x), v, np.int32)) for v in (b, t)), pa.array(keys[:, t]), part.column("id"), packed]
                    yield pa.RecordBatch.from_arrays(columns, names)

    label = classes.schema["label"].dataType.simpleString()
    entry = f"label {label}, width int, bits int, tab int, key long, id long, code binary"
    entries = c.materialize(classes.select("label", "width", "size", "id", "embedding").mapInArrow(index, entry), "hamming-tables")
    bucket = ["label", "width", "tab", "key"]
    heavy = entries.groupBy(*bucket).agg(F.count("*").alias("size")).filter(F.col("size") > block)
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    dealt = entries.join(heavy, bucket, "left").withColumn("blocks", F.coalesce(F.ceil(F.col("size") / block), F.lit(1)).cast("int")).withColumn("own", own).withColumn("pair", F.explode(pairs))
    # light buckets go to a task by the dozen, a heavy one by itself
    part = F.when(F.col("blocks") == 1, F.floor(F.col("key") / TOGETHER)).otherwise(-1 - F.col("key"))
    group = ["label", "width", "bits", "tab", "part", "i", "j"]
    dealt = dealt.select("label", "width", "bits", "tab", part.cast("long").alias("part"), F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "key", "own", "id", "code")

    def near_codes(key, table):
        """Members with a code near enough to one that they meet here first."""
        width, bits, tab, i, j = (key[k].as_py() for k in (1, 2, 3, 5, 6))
        keys, own = table.column("key").to_numpy(), table.column("own").to_numpy()
        codes = np.frombuffer(b"".join(table.column("code").to_pylist()), "<u4").reshape(len(keys), -1)
        far = codes_for(width, bits)[0].far
        on = np.zeros(len(keys), bool)
        for rows in _buckets(keys):
            mine = codes[rows]
            limit = far * mine.shape[1] * bits
            step = max(1, _STEP // mine.size)
            for at in range(0, len(rows), step):
                cut = slice(at, at + step)
                away = np.bitwise_count(mine[cut, None, :] ^ mine[None, :, :]).sum(2, dtype=np.int32)
                on[rows[cut]] |= ((away <= limit) & _open(mine, own[rows], cut, tab, i == j)).any(1)
        return table.filter(pa.array(on))

    group_kind = f"label {label}, width int, bits int, tab int, part long, i int, j int, key long, own int, id long, code binary"
    active = c.materialize(dealt.groupBy(*group).applyInArrow(near_codes, group_kind), "near-codes")
    fetched = active.join(classes.select("id", "m", "embedding"), "id")

    def compare(key, table):
        width, tab, i, j = (key[k].as_py() for k in (1, 3, 5, 6))
        keys, own, ids, times = (table.column(k).to_numpy() for k in ("key", "own", "id", "m"))
        codes = np.frombuffer(b"".join(table.column("code").to_pylist()), "<u4").reshape(len(keys), -1)
        x = _unit(pc.list_flatten(table.column("embedding").combine_chunks()).to_numpy().reshape(-1, width))
        counted, moved, towards = np.zeros(len(ids), np.int64), [], []
        for rows in _buckets(keys):
            near = (x[rows] @ x[rows].T >= threshold) & _open(codes[rows], own[rows], slice(None), tab, i == j)
            counted[rows] += near @ times[rows]
            root = np.arange(len(rows))
            while True:
                low = np.minimum(root, np.where(near, root[None, :], len(rows)).min(1))
                low = low[low]
                if (low == root).all():
                    break
                root = low
            away = np.flatnonzero(root != np.arange(len(rows)))
            moved.append(ids[rows[away]])
            towards.append(ids[rows[root[away]]])
        some, none = np.flatnonzero(counted), np.zeros(0, np.int64)
        a = np.concatenate([ids[some], *moved, none])
        b = pa.array(np.concatenate([np.zeros(len(some), np.int64), *towards, none]), mask=np.arange(len(a)) < len(some))
        n = np.concatenate([counted[some], np.zeros(len(a) - len(some), np.int64)])
        return pa.Table.from_arrays([pa.array(a, pa.int64()), b, pa.array(n, pa.int64())], ["a", "b", "n"])

    return fetched.groupBy(*group).applyInArrow(compare, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors``."""
    c.small_batches(vectors.sparkSession)
    vectors = vectors.select(F.col("vec_id").cast("long"), "embedding", "label")
    fine = usable()
    good = vectors.filter(fine)
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"))
    # a vec_id may stand for several vectors: each has a number of its own, which is fixed as it is written
    classes = c.materialize(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    found = c.materialize(link(classes, threshold, block), "vector-links")
    counts = found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    parts = components(found.filter("b is not null").select("a", "b"))
    classes = c.materialize(classes.join(counts, "id", "left").join(parts, "id", "left"), "linked-classes")
    names = classes.filter("component is not null").groupBy("component").agg(F.min("least").alias("name"))
    classes = classes.join(names, "component", "left")
    classes = classes.select("label", "embedding", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("name", "least").alias("component_id"))
    linked = good.join(classes, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = vectors.filter(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_itq_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op3_itq_embeddings": op3_itq_embeddings}
ORACLES: dict[str, str] = {}
