"""Packing documents into fixed windows by non-negative least squares.

A document's ids are cut into full windows and one rest, so every decision
after that needs only the histogram of rest lengths (at most ``window`` bins).
Shallow length combinations that fill a window are enumerated, their repeat
counts solved by non-negative least squares against the histogram and rounded;
what is left is packed greedily, largest first. The plan says, for each length,
which ranks go to which sequence and offset; Spark ranks the pieces within
their length and looks each one up.

Edge cases: a null or empty text is one piece holding the end id; rows that
repeat a doc_id, or have none, are packed each on its own; other columns are
ignored; an empty table gives no piece.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as c
from .tokens import crc32, default_vocabulary, encoder

WINDOW, END_ID = 2048, 1
#: Padding of an enumerated combination, in tokens, at most.
SLACK = 16
#: Combinations enumerated for each largest member.
SPLITS = 6


def pieces(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, part, nth): nth counts the pieces of a length in one task."""
    vocabulary = vocabulary or default_vocabulary()
    c.small_batches(docs.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"]

    def run(batches):
        tail, part, seen = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), {}
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(vocabulary).encode(batch.column("text").to_pylist())):
                ids += tail
                total = len(ids) // 4
                for start in range(0, total, window):
                    length = min(window, total - start)
                    nth = seen[length] = seen.get(length, -1) + 1
                    rows.append((doc_id, start, length, crc32(ids[4 * start : 4 * (start + length)]), total, part, nth))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * 7, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


@dataclass
class Plan:
    """Rank r of a length, lo <= r < hi: sequence first + (r - lo) // times, at base + (r - lo) % times * length."""

    length: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray
    base: np.ndarray
    times: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = int(self.hi.max(initial=0)) + 1
        row = np.searchsorted(self.length * width + self.lo, length * width + rank, side="right") - 1
        at = rank - self.lo[row]
        return self.first[row] + at // self.times[row], self.base[row] + at % self.times[row] * length


def combinations(lengths: np.ndarray, window: int, slack: int = SLACK, splits: int = SPLITS) -> np.ndarray:
    """Rows of up to three lengths (0: none) that together leave at most ``slack`` of a window."""
    below = np.zeros(window + 1, np.int64)  # the largest length present that is at most the index
    below[lengths] = lengths
    below = np.maximum.accumulate(below)
    rows = []
    for a in lengths[::-1]:
        rest = window - a
        b = below[min(rest, a)]
        for step in range(splits):
            if not b:
                break
            rows.append((a, b, below[min(rest - b, b)]))
            b = below[min(b - 1, rest * (splits - step) // (splits + 1))] if b > 1 else 0
    table = np.array(rows, np.int64).reshape(-1, 3)
    return np.unique(table[table.sum(1) >= window - slack], axis=0)


def repeat_counts(table: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """min ||A x - histogram||, x >= 0, by accelerated projected gradient; A counts a combination's lengths."""
    if not len(table):
        return np.zeros(0)
    size, width = len(histogram), table.shape[1]
    forward = lambda x: np.bincount(table.ravel(), np.repeat(x, width), size) * (np.arange(size) > 0)
    back = lambda y: (y * (np.arange(size) > 0))[table].sum(1)
    probe = np.ones(len(table))
    for _ in range(20):
        probe = back(forward(probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    x = y = np.zeros(len(table))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(forward(y) - histogram) / (1.05 * norm))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / after * (new - x), new, after
    return x


def make_plan(histogram: np.ndarray, window: int = WINDOW) -> Plan:
    """``histogram[n]``: pieces of n tokens, n <= window."""
    left, used = histogram.astype(np.int64).copy(), np.zeros(window + 1, np.int64)
    rows, sequence = [], 0

    def put(members: list[int], count: int) -> None:
        nonlocal sequence
        base = 0
        for n in sorted(set(members), reverse=True):
            times = members.count(n)
            rows.append((n, used[n], used[n] + times * count, sequence, base, times))
            used[n] += times * count
            left[n] -= times * count
            base += times * n
        sequence += count

    if left[window]:
        put([window], int(left[window]))
    present = np.flatnonzero(left)
    table = combinations(present, window) if len(present) else np.zeros((0, 3), np.int64)
    x = repeat_counts(table, left.astype(float))
    for i in np.argsort(-x, kind="stable"):
        if x[i] < 0.5:
            break
        members = [int(n) for n in table[i] if n]
        count = min(int(x[i] + 0.5), *(int(left[n]) // members.count(n) for n in members))
        if count:
            put(members, count)
    while left.any():
        present = np.flatnonzero(left)
        members, rest = [], window
        while len(present) and (k := np.searchsorted(present, rest, side="right")):
            n = int(present[k - 1])
            times = min(rest // n, int(left[n]) - members.count(n))
            if times < 1:
                present = np.delete(present, k - 1)
                continue
            members += [n] * times
            rest -= times * n
            if times == left[n]:
                present = np.delete(present, k - 1)
        put(members, min(int(left[n]) // members.count(n) for n in set(members)))
    rows = np.array(sorted(rows), np.int64).reshape(-1, 6)
    return Plan(*rows.T, sequence)


def pack(parts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to ``pieces``' rows; the driver sees at most ``window`` counts."""
    spark = parts.sparkSession
    parts = c.materialize(parts, "pieces")
    counts = parts.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = c.materialize(counts.select("part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")), "piece-counts")
    histogram = np.zeros(window + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():
        histogram[length] = n
    plan = make_plan(histogram, window)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in ("length", "rank"))
            sequence, offset = plan.place(length, rank)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    # as many rows as tasks times lengths: more than a broadcast should hold
    ranked = parts.join(counts.select("part", "length", "earlier").hint("merge"), ["part", "length"]).select(*names, (F.col("earlier") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, ", ".join(f"{n} long" for n in [*names, "sequence_id", "offset"]))


def op10_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(c.documents(spark, sf_dir)))


QUERIES = {"op10_nnls_packing": op10_nnls_packing}
ORACLES: dict[str, str] = {}
