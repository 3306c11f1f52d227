"""A corpus from raw documents to packed training windows.

Each stage reads what the one before kept. Quality and toxicity drop what their
models reject, the shingle join keeps one document of each group of near copies
(the one with the smallest doc_id, and of several texts under it the one with
the smallest hash), repeated passages are cut out of the texts,
and packing turns what is left into windows. Learning uses the labels of the
documents that reach a stage.

Edge cases are those of the operators. Two texts under one doc_id that are not
copies of each other both stay; rows equal in doc_id and text count once after
the join; of a group without any doc_id one row stays; documents without a word
are no copies of each other. A text from which something was cut keeps the white
space between the words that stay; one from which everything was cut stays as an
empty one. A table without ``lang`` gets the default threshold everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm import _common as c
from loamgrid.llm import jaccard, packing, quality, substrings, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field finds good."""
    model = quality.fit(docs, _labels(spark, sf_dir))
    return quality.score(docs, model).filter("good").select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below their language's threshold."""
    model = toxicity.fit(docs, _labels(spark, sf_dir))
    return toxicity.score(docs, model).filter("not toxic").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles."""
    found = jaccard.shingle_components(docs)
    keep = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("component_hash")))
    keep = keep.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_same"))
    keyed = docs.withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = keyed.join(keep, (F.col("_hash") == F.col("_same")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_hash"]).select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand elsewhere before."""
    kept = substrings.remove_repeats(docs, spaces=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    kept = kept.withColumn("text", text)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in windows."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicate_stage),
    ("repeated passages", substring_stage),
    ("packing", packing_stage),
]

#: Trained models and a tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read by the next."""
    docs = c.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = c.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
