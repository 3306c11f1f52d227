"""Token ids of a corpus as ORC files in ascending id order.

ORC keeps the ids as run-length encoded integers in stripes, with a row index
every ``row_index_stride`` rows and a Bloom filter on ``doc_id``; stripes are
read in parallel, and a lookup by id skips those whose statistics or filter
rule it out (``spark.read.orc(path).filter("doc_id = 7")``).

A row also carries its file's number (``part``) and its place in it (``nth``),
so a reader knows the order of all documents without trusting that of a scan.

Edge cases: a null text is an empty one (only the end id); a null doc_id comes
first; rows that repeat an id are ordered by text, equal ones after one another;
other columns are ignored; an empty table gives an empty file set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as c
from .tokens import crc32, default_vocabulary, encoder

END_ID = 2
SCHEMA = "doc_id long, part int, nth long, ids array<int>"


def encode_documents(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, part, nth, ids) in ascending id order over range partitions."""
    vocabulary = vocabulary or default_vocabulary()
    c.small_batches(docs.sparkSession)

    def run(batches):
        tail, part, seen = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [x + tail for x in encoder(vocabulary).encode(batch.column("text").to_pylist())]
            ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            nth = np.arange(seen, seen + len(ids))
            seen += len(ids)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(len(ids), part, np.int32)), pa.array(nth), pa.ListArray.from_arrays(ends, flat)], ["doc_id", "part", "nth", "ids"])

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, SCHEMA)


def write_token_files(ids: DataFrame, path: str, stripe_bytes: int = 64 << 20, row_index_stride: int = 10_000) -> None:
    """One ORC file per range partition; file order is id order."""
    writer = ids.write.option("compression", "zstd").option("orc.stripe.size", stripe_bytes)
    writer = writer.option("orc.create.index", "true").option("orc.row.index.stride", row_index_stride)
    writer.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, nth, ids) of all stripes."""
    return spark.read.schema(SCHEMA).orc(path)


def digest(tokens: DataFrame) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32.

    ``start`` is a running sum inside each file plus the totals of the files
    before it, so no task sees more than one file's counts.
    """
    c.small_batches(tokens.sparkSession)

    def run(batches):
        for batch in batches:
            column = batch.column("ids")
            flat, ends = column.flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(column).to_numpy())
            parts = np.split(flat.astype("<u4"), ends[:-1]) if len(ends) else []
            sums = pa.array([crc32(p.tobytes()) for p in parts], pa.int64())
            sizes = pa.array([len(p) for p in parts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "part", "nth")), sizes, sums], ["doc_id", "part", "nth", "n_tokens", "ids_crc32"])

    counted = c.materialize(tokens.mapInArrow(run, "doc_id long, part int, nth long, n_tokens long, ids_crc32 long"), "token-digest")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = counted.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    files = files.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("nth")
    start = F.col("base") + F.coalesce(F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.join(files, "part").select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")


def op7_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = c.shared_path(spark, "tokens-orc")
    write_token_files(encode_documents(c.documents(spark, sf_dir)), path)
    return digest(read_token_files(spark, path))


QUERIES = {"op7_orc_token_ids": op7_orc_token_ids}
ORACLES: dict[str, str] = {}
