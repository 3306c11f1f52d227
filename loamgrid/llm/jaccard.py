"""Exact Jaccard links between documents' word shingles by signature trees.

Documents with equal shingle sets form one class. Two sets can only reach the
similarity if they share one of their first shingles in a common order that
puts frequent shingles last, so each such shingle roots a group of classes that
may link; roots with the same least class are one. In a group, bitmaps of the sets
are the leaves of a signature tree: a node holds the OR and the AND of its
bitmaps and its range of sizes. Two trees are traversed at once, and a pair of
nodes is dropped if even the largest overlap that its bitmaps and sizes allow is
too small, or if everything below is in one component already. What is left
is compared on the shingles of the whole texts.

Before the traversal a few rounds link each class with one likely partner of its
groups, checked the same way; a family of thousands of near copies is then one
component, and the traversal need not look at its pairs. Only pairs inside one
component are ever passed over, so the components are exact. Shingles are
compared by a 64-bit hash.

Edge cases: a document without words, or null, has no shingles and links with
nothing; one with fewer words than a shingle is one shingle; rows that repeat a
doc_id are documents of their own; a null doc_id is never the smallest of a
component unless it holds no other; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c
from .components import components

WORDS, PERCENT = 5, 80
#: Bits of a bitmap for each shingle, at least; leaves below a node of the lowest level, nodes below a higher one.
BITS, LEAF, FANOUT = 4, 16, 8
#: Shingles known as frequent are at most so many; they change the order of shingles only, not the result.
FREQUENT = 100_000
ROUNDS, BLOCK, STAR = 4, 2048, 256
#: Ids up to which a scan of the texts is filtered by broadcast (24 bytes each); beyond it by a shuffle.
BROADCAST_IDS = 200_000


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, ends = c.text_bytes(texts)
    if len(data):
        data = np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(32), data)
    at, to, row = c.word_spans(data, ends)
    hashes = c.span_hashes(data, at, to)
    whole = c.window_hashes(hashes, words)
    counts = np.bincount(row, minlength=len(ends))
    first = np.cumsum(counts) - counts
    out = []
    for i, n in zip(first.tolist(), counts.tolist()):
        if n >= words:
            out.append(np.unique(whole[i : i + n - words + 1]))
        elif n:
            out.append(c.span_hashes(hashes, np.array([i]), np.array([i + n])) + np.uint64(n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def enough(overlap, a, b, percent: int = PERCENT):
    """Whether sets of sizes a and b with this overlap reach ``percent`` of their union."""
    return (100 + percent) * overlap >= percent * (a + b)


def frequent_shingles(docs: DataFrame, limit: int = FREQUENT) -> np.ndarray:
    """Shingles that many documents hold, rarest first, counted over all rows.

    A task reports those that at least three of its documents of one chunk hold,
    so that what is shuffled stays well below the number of shingles.
    """

    def run(batches):
        for batch in batches:
            for part in c.chunks(batch):
                sets = {x.tobytes(): x for x in shingle_sets(part.column("text"))}
                token, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets.values()]), return_counts=True)
                many = n >= 3
                yield pa.RecordBatch.from_arrays([pa.array(token[many].view(np.int64)), pa.array(n[many])], ["token", "n"])

    counts = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.filter("n >= 32").orderBy(F.desc("n"), "token").limit(limit).toArrow()
    return top.column("token").to_numpy().view(np.uint64)[::-1].copy()


def _bitmap(tokens: np.ndarray) -> bytes:
    width = 1 << max(6, int(BITS * len(tokens) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(c.mix(tokens, 5) & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def signatures(docs: DataFrame, frequent: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_hash, k, n, short, prefix, bitmap): k names the set.

    Two linked sets share a shingle of their prefixes, and it is among the first
    ``short`` of the smaller one's.
    """
    order = np.argsort(frequent)
    known, rank = frequent[order], order.astype(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast((known, rank))  # at most FREQUENT entries

    def run(batches):
        known, rank = shared.value
        for batch in batches:
            for part in c.chunks(batch):
                ks, ns, shorts, prefixes, maps = [], [], [], [], []
                for x in shingle_sets(part.column("text")):
                    n = len(x)
                    size = n - (percent * n + 99) // 100 + 1 if n else 0
                    key = x >> np.uint64(1)
                    if len(known) and n:
                        spot = np.minimum(np.searchsorted(known, x), len(known) - 1)
                        key = np.where(known[spot] == x, np.uint64(2**63) + rank[spot], key)
                    chosen = x[np.argsort(key, kind="stable")[:size]] if n else x
                    prefixes.append(chosen.view(np.int64))
                    maps.append(_bitmap(x) if n else b"")
                    ns.append(n)
                    shorts.append(n - (2 * percent * n + 99 + percent) // (100 + percent) + 1 if n else 0)
                    ks.append(int((c.mix(np.array([n], np.uint64)) + np.add.reduce(c.mix(x, 3)))[0].view(np.int64)))
                ends = np.append(0, np.cumsum([len(p) for p in prefixes])).astype(np.int32)
                flat = pa.array(np.concatenate([np.zeros(0, np.int64), *prefixes]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(ks, pa.int64()), pa.array(ns, pa.int64()), pa.array(shorts, pa.int64()), pa.ListArray.from_arrays(ends, flat), pa.array(maps, pa.binary())],
                    ["doc_id", "text_hash", "k", "n", "short", "prefix", "bitmap"],
                )

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, "doc_id long, text_hash long, k long, n long, short long, prefix array<long>, bitmap binary")


def groups(classes: DataFrame) -> DataFrame:
    """(g, k): classes that share a prefix shingle with class g, the least one that has the shingle.

    All shingles whose least class is g make one group, so a class stands in it once.
    """
    posts = classes.select("k", "short", F.posexplode("prefix").alias("at", "token"))
    # added up in each task first, so that a shingle of a million classes is no task's burden; the join may split it
    roots = posts.groupBy("token").agg(F.min("k").alias("g"), F.max("k").alias("last"), F.max(F.col("at") < F.col("short")).alias("early"))
    return posts.join(roots.filter("g < last and early").select("token", "g"), "token").select("g", "k").distinct()


def plausible(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose bitmaps and sizes leave room for a link."""
    sides = {x: classes.select(F.col("k").alias(x), F.col("n").alias(f"n_{x}"), F.col("bitmap").alias(f"map_{x}")) for x in "ab"}

    @F.arrow_udf("boolean")
    def run(n_a: pa.Array, n_b: pa.Array, map_a: pa.Array, map_b: pa.Array) -> pa.Array:
        out = []
        for x, y, p, q in zip(n_a.to_numpy(), n_b.to_numpy(), map_a.to_pylist(), map_b.to_pylist()):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            size = min(len(p), len(q))
            while len(p) > size:
                p = p[: len(p) // 2] | p[len(p) // 2 :]
            while len(q) > size:
                q = q[: len(q) // 2] | q[len(q) // 2 :]
            most = min(x - int(np.bitwise_count(p & ~q).sum()), y - int(np.bitwise_count(q & ~p).sum()), x, y)
            out.append(bool(enough(most, x, y, percent)))
        return pa.array(out, pa.bool_())

    sized = pairs.join(sides["a"], "a").join(sides["b"], "b").filter((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")))
    return sized.filter(run("n_a", "n_b", "map_a", "map_b")).select("a", "b")


def texts_of(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(k, text) of the classes that ``pairs`` name."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    rows = c.materialize(ids.join(classes.select("k", F.struct("doc_id", "text_hash").alias("row")), "k"), "ids")
    if rows.count() <= BROADCAST_IDS:
        rows = F.broadcast(rows)
    found = docs.select(F.struct("doc_id", "text_hash").alias("row"), "text").join(rows, "row")
    return found.groupBy("k").agg(F.first("text").alias("text"))


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets reach ``percent``, compared on the shingles of the whole texts."""
    texts = texts_of(pairs, classes, docs)
    stars = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    members = pairs.join(stars, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    members = members.join(texts.withColumnRenamed("k", "b"), "b").select("a", "part", "b", "text")
    heads = stars.join(texts.withColumnRenamed("k", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "text")

    def run(table):
        ids = table.column("b").to_pylist()
        head = ids.index(None)
        sets = shingle_sets(table.column("text").combine_chunks())
        x = sets[head]
        linked = [b for b, y in zip(ids, sets) if b is not None and enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent)]
        a = table.column("a")[0].as_py()
        c.give_back()
        return pa.Table.from_arrays([pa.array([a] * len(linked), pa.int64()), pa.array(linked, pa.int64())], ["a", "b"])

    return members.unionByName(heads).groupBy("a", "part").applyInArrow(run, "a long, b long")


class SignatureTree:
    """Levels of nodes over bitmaps of one width, sorted by size; level 0 holds the sets themselves."""

    def __init__(self, n: np.ndarray, maps: np.ndarray, part: np.ndarray):
        self.levels = [(maps, maps, n, n, part)]
        step = LEAF
        while len(self.levels[-1][2]) > 1:
            either, both, low, high, part = self.levels[-1]
            at = np.arange(0, len(low), step)
            same = np.minimum.reduceat(part, at) == np.maximum.reduceat(part, at)
            part = np.where(same & (np.minimum.reduceat(part, at) >= 0), part[at], -1)
            self.levels.append((np.bitwise_or.reduceat(either, at), np.bitwise_and.reduceat(both, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), part))
            step = FANOUT

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child and number of children one level down."""
        step = LEAF if level == 1 else FANOUT
        return node * step, np.minimum(step, len(self.levels[level - 1][2]) - node * step)


def _possible(one: SignatureTree, two: SignatureTree, i: int, j: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    (or_a, and_a, low_a, high_a, part_a), (or_b, and_b, low_b, high_b, part_b) = one.levels[i], two.levels[j]
    keep = np.zeros(len(a), bool)
    for s in range(0, len(a), 20_000):
        p, q = a[s : s + 20_000], b[s : s + 20_000]
        lost_a = np.bitwise_count(and_a[p] & ~or_b[q]).sum(1, dtype=np.int64)
        lost_b = np.bitwise_count(and_b[q] & ~or_a[p]).sum(1, dtype=np.int64)
        most = np.minimum(np.minimum(high_a[p] - lost_a, high_b[q] - lost_b), np.minimum(high_a[p], high_b[q]))
        keep[s : s + 20_000] = enough(most, low_a[p], low_b[q], percent) & ~((part_a[p] == part_b[q]) & (part_a[p] >= 0))
    return keep


def traverse(one: SignatureTree, two: SignatureTree, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets, one of each tree, that may link and are not in one component."""
    i, j = len(one.levels) - 1, len(two.levels) - 1
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        on = _possible(one, two, i, j, a, b, percent)
        if one is two:
            on &= a <= b
        a, b = a[on], b[on]
        if not (i or j) or not len(a):
            break
        if i >= j and i:
            first, n = one.children(i, a)
            b = np.repeat(b, n)
            a, i = c.ragged(first, n), i - 1
        if j > i or (one is two and j):
            first, n = two.children(j, b)
            a = np.repeat(a, n)
            b, j = c.ragged(first, n), j - 1
    return a, b


def tree_candidates(members: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of different components that a group's trees leave: members are (g, k, part)."""
    # a small group is one block; a larger one's largest component comes in blocks that meet only those of all others:
    # it is never compared with itself
    parts = members.groupBy("g", "part").agg(F.count("*").alias("size"))
    sizes = parts.groupBy("g").agg(F.count("*").alias("parts"), F.sum("size").alias("size"), F.max(F.struct("size", "part")).alias("main")).filter("parts > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    large, main = F.col("size") > BLOCK, F.col("main.size")
    sizes = sizes.select("g", F.when(large, F.col("main.part")).alias("main"), F.when(large, blocks(main)).otherwise(0).alias("mains"), F.when(large, blocks(F.col("size") - main)).otherwise(1).alias("others"))
    live = members.join(sizes, "g").join(classes.select("k", "n", "bitmap"), "k")
    in_main, hashed = F.col("part").eqNullSafe(F.col("main")), F.xxhash64("k")
    own = F.when(in_main, F.pmod(hashed, F.col("mains"))).otherwise(F.col("mains") + F.pmod(hashed, F.col("others"))).cast("int")
    first = F.when(in_main, F.col("mains")).otherwise(F.lit(0))
    pairs = F.transform(F.sequence(first, F.col("mains") + F.col("others") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    dealt = live.withColumn("own", own).withColumn("pair", F.explode(pairs))

    def run(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        ks, ns, parts, own = (table.column(x).to_numpy() for x in ("k", "n", "part", "own"))
        maps = table.column("bitmap").to_pylist()
        _, parts = np.unique(parts, return_inverse=True)
        width = np.array([len(m) for m in maps])
        found = []

        def tree(on: np.ndarray, size: int) -> tuple[SignatureTree, np.ndarray] | None:
            rows = np.flatnonzero(on)
            if not len(rows):
                return None
            rows = rows[np.lexsort((ks[rows], parts[rows], ns[rows]))]
            bits = np.frombuffer(b"".join(maps[r] for r in rows), np.uint64).reshape(len(rows), -1)
            while bits.shape[1] * 8 > size:
                bits = bits[:, : bits.shape[1] // 2] | bits[:, bits.shape[1] // 2 :]
            return SignatureTree(ns[rows], bits, parts[rows]), rows

        for size in np.unique(width):
            for other in (size, 2 * size):  # linked sets differ by a quarter in size at most, so by one doubling
                for left, right in {(i, j), (j, i)} if other != size else {(i, j)}:
                    x = tree((width == size) & (own == left), size)
                    y = x if other == size and i == j else tree((width == other) & (own == right), size)
                    if x and y:
                        a, b = traverse(x[0], y[0], percent)
                        found.append(np.stack([ks[x[1][a]], ks[y[1][b]]], 1))
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *found])
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        return pa.Table.from_arrays([pa.array(pairs.min(1) if len(pairs) else [], pa.int64()), pa.array(pairs.max(1) if len(pairs) else [], pa.int64())], ["a", "b"])

    grouped = dealt.select("g", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "k", "n", "bitmap", "part", "own").groupBy("g", "i", "j")
    return grouped.applyInArrow(run, "a long, b long").distinct()


def _with_part(members: DataFrame, parts: DataFrame | None, name: str = "part") -> DataFrame:
    """``members`` (k and more) with the component (id, component) of each as far as ``parts`` say."""
    if parts is None:
        return members.withColumn(name, F.col("k"))
    return members.join(parts.withColumnRenamed("id", "k"), "k", "left").withColumn(name, F.coalesce("component", "k")).drop("component")


def _joined(parts: DataFrame | None, links: DataFrame) -> DataFrame:
    """(id, component) after more links."""
    if parts is not None:
        links = links.unionByName(parts.select(F.col("id").alias("a"), F.col("component").alias("b")))
    return components(links)


def shingle_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and component_hash for every row of ``docs`` (doc_id, text).

    These two name the row of the component with the smallest doc_id, then the
    smallest text_hash; nulls come last.
    """
    c.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    rows = c.materialize(signatures(docs, frequent_shingles(docs), percent), "signatures")
    full = rows.filter("n > 0")
    classes = full.groupBy("k").agg(F.first("n").alias("n"), F.first("short").alias("short"), F.first("prefix").alias("prefix"), F.first("bitmap").alias("bitmap"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("row"))
    classes = c.materialize(classes.select("k", "n", "short", "prefix", "bitmap", "row.doc_id", "row.text_hash"), "classes")
    members = c.materialize(groups(classes), "groups")
    parts, tried = None, None
    state = c.materialize(_with_part(members, parts), "parts")
    for _ in range(ROUNDS):
        lead = state.groupBy("g").agg(F.min(F.struct("part", "k")).alias("lead"), F.max("part").alias("high")).filter("lead.part < high")
        votes = state.join(lead, "g").filter("part != lead.part").groupBy(F.col("lead.k").alias("a"), F.col("k").alias("b")).agg(F.count("*").alias("n"))
        if tried is not None:
            votes = votes.join(tried, ["a", "b"], "left_anti")
        chosen = votes.groupBy("b").agg(F.max(F.struct("n", (-F.col("a").cast("decimal(20,0)")).alias("order"), "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
        chosen = c.materialize(chosen, "star")
        if chosen.isEmpty():
            break
        found = c.materialize(verify(c.materialize(plausible(chosen, classes, percent), "plausible"), classes, docs, percent), "links")
        tried = chosen if tried is None else tried.unionByName(chosen)
        if not found.isEmpty():
            parts = _joined(parts, found)
            state = c.materialize(_with_part(members, parts), "parts")
    late = c.materialize(tree_candidates(state, classes, percent), "candidates")
    if tried is not None:
        late = late.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    late = c.materialize(late, "late")
    if not late.isEmpty():
        found = c.materialize(verify(late, classes, docs, percent), "links")
        if not found.isEmpty():
            parts = _joined(parts, found)
    roots = c.materialize(_with_part(classes.select("k", "doc_id", "text_hash"), parts, "root"), "roots")
    least = roots.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("least"))
    named = roots.join(least, "root").select("k", F.col("least.doc_id").alias("component_id"), F.col("least.text_hash").alias("component_hash"))
    known = full.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "k").join(named, "k").drop("k")
    bare = rows.filter("n = 0").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("text_hash").alias("component_hash"))
    return known.unionByName(bare)


def op6_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_components(c.documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op6_signature_tree_join": op6_signature_tree_join}
ORACLES = {
    "op6_signature_tree_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN sizes m ON m.doc_id = p.a JOIN sizes n ON n.doc_id = p.b WHERE 100 * p.both >= 80 * (m.n + n.n - p.both)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id"""
}
