"""Shared helpers of the text operators: scratch tables, word offsets, hashes.

Everything here works on one Arrow batch at a time, so memory follows the
batch and not the partition.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handed to one vectorised pass, in bytes; a longer document is a pass of its own.
CHUNK_BYTES = 1 << 20
#: Bytes of one Arrow batch, where the session does not ask for fewer.
BATCH_BYTES = 4 << 20
#: The id that stands for a null doc_id: below every other id.
NULL_ID = -(2**63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches bounded in bytes, as rows here are whole texts; one longer text is a batch of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    asked = spark.conf.get(key, str(2**31 - 1)).lower().rstrip("b")
    if asked.isdigit() and int(asked) > BATCH_BYTES:  # a size with a unit is someone's choice
        spark.conf.set(key, str(BATCH_BYTES))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which every executor sees."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/loamgrid-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: its lineage ends there."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(doc_id, n: int):
    """crc32 of the id as text, modulo n; a null id counts as remainder -1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1))


def give_back() -> None:
    """Return freed memory to the system: workers live on, and the next stage's code shares an executor with them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows whose texts hold about ``limit`` bytes."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop
    give_back()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's end; null counts as empty."""
    kind = pa.large_binary()
    column = column.cast(pa.large_string()).fill_null("").cast(kind)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] else np.zeros(0, np.uint8)
    return data, offsets[1:] - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, row_ends: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each stretch of bytes outside ``space``; no word crosses a row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    ink = ~space[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    inner = row_ends[(row_ends > 0) & (row_ends < len(data))]
    first[inner] |= ink[inner]  # a row that begins with a word
    starts = np.flatnonzero(first)
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    last[inner - 1] |= ink[inner - 1]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(row_ends, starts, side="right")


_BASE = 0x9E3779B97F4A7C15
#: Values hashed in one vectorised step: what a step holds follows this and not the text.
_STEP = 1 << 16
_powers: list[np.ndarray] = []


def _power_table() -> np.ndarray:
    """The base's powers below _STEP, made on first use."""
    if not _powers:
        table = np.full(_STEP, _BASE, np.uint64)
        table[0] = 1
        _powers.append(np.cumprod(table, dtype=np.uint64))
    return _powers[0]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: each input bit changes half of the output bits."""
    x = x + np.uint64((0x632BE59BD9B4E019 * (seed + 1)) % 2**64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash modulo 2**64 of values[start:end] for every span, the same wherever it stands."""
    powers, size = _power_table(), ends - starts
    out, total = np.zeros(len(starts), np.uint64), np.append(0, np.cumsum(size))
    at = 0
    while at < len(starts):
        stop = int(np.searchsorted(total, total[at] + _STEP, side="right")) - 1
        if stop <= at:  # a span longer than a step
            scale, n = 1, int(ends[at])
            for i in range(int(starts[at]), n, _STEP):
                part = values[i : min(n, i + _STEP)].astype(np.uint64) + np.uint64(1)
                out[at : at + 1] += (part * powers[: len(part)]).sum(dtype=np.uint64, keepdims=True) * np.uint64(scale)
                scale = scale * pow(_BASE, _STEP, 2**64) % 2**64
            at += 1
            continue
        some = np.flatnonzero(size[at:stop]) + at
        if len(some):
            first = total[some] - total[at]
            place = np.arange(total[stop] - total[at]) - np.repeat(first, size[some])
            term = (values[place + np.repeat(starts[some], size[some])].astype(np.uint64) + np.uint64(1)) * powers[place]
            out[some] = np.add.reduceat(term, first)
        at = stop
    return mix(out)


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive values (whether or not it crosses a row)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out += (values[i : i + n].astype(np.uint64, copy=False) + np.uint64(1)) * np.uint64(pow(_BASE, i, 2**64))
    return mix(out)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes start, start+1, ... of all spans, one after another."""
    if not len(starts):
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, lang, text and y of at most ``per_class`` documents of each label, and how many documents have each.

    Only labels of documents in ``docs`` count, and the places of the sample go
    to such documents alone, in hash order of their ids. Of several labels of one
    document the lowest counts; labels other than 0 and 1 are ignored; of several
    texts under one doc_id the one with the smallest hash is learnt from. A table
    without ``lang`` has nulls there.
    """
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    known = labels.groupBy("doc_id").agg(F.min(F.when(F.col(column).isin(0, 1), F.col(column))).alias("y")).filter("y is not null")
    met = docs.select("doc_id", text_hash.alias("text_hash")).join(known, "doc_id").groupBy("doc_id", "y").agg(F.min("text_hash").alias("text_hash"))
    met = materialize(met, f"labelled-{column}")
    rates = {r["y"]: r["n"] for r in met.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [met.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    picked = picked[0].unionByName(picked[1])  # two times per_class rows at most
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    rows = docs.select("doc_id", lang.cast("string").alias("lang"), "text", text_hash.alias("text_hash"))
    return rows.join(F.broadcast(picked), ["doc_id", "text_hash"]).dropDuplicates(["doc_id"]).select("doc_id", "lang", "text", "y"), rates


def labelled(docs: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """doc_id, text and y of all documents that ``labelled_sample`` picks from, once each and written for reading again."""
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    known = labels.groupBy("doc_id").agg(F.min(F.when(F.col(column).isin(0, 1), F.col(column))).cast("int").alias("y")).filter("y is not null")
    met = docs.select("doc_id", "text", text_hash.alias("text_hash")).join(known, "doc_id")
    one = met.groupBy("doc_id", "y").agg(F.min_by("text", "text_hash").alias("text"))
    return materialize(one, f"all-labelled-{column}")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic fit of y to z, by damped Newton steps."""
    x = np.stack([z, np.ones_like(z)], 1)
    rate = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
    start = np.array([1.0, 0.0])
    theta, ridge = start.copy(), 0.5
    target = np.where(y > 0, 1 - 1e-3, 1e-3)
    for _ in range(50):
        p = sigmoid(x @ theta)
        grad = x.T @ (weight * (p - target)) + ridge * (theta - start)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta = theta - step * min(1, 2 / (np.abs(step).max() + 1e-9))
    if theta[0] < 0.1:  # the raw score says nothing: fall back on the rate
        return 0.1, float(np.log(rate / (1 - rate)) - 0.1 * z.mean())
    return float(theta[0]), float(theta[1])
