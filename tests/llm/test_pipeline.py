"""The stages against what their operators say on their own input."""

import corpus_pipeline as P
from pyspark.sql import functions as F

from loamgrid.llm import _common as c
from loamgrid.llm import packing

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = c.documents(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in P.STAGES[:-1]:
        after = c.materialize(stage(spark, docs, SF), "stage")
        assert after.columns == docs.columns and 0 < after.count() <= docs.count(), name
        if name == "near duplicates":
            gone = docs.join(after, "doc_id", "left_anti").count()
            assert gone > 0 and after.select("text").distinct().count() == after.count()
        if name == "quality":
            clean = docs.join(labels.filter("quality = 1"), "doc_id").count()
            assert after.join(labels.filter("quality = 1"), "doc_id").count() >= 0.9 * clean
        docs = after
    packed = P.STAGES[-1][1](spark, docs, SF)
    want = packing.pieces(docs).agg(F.sum("length")).first()[0]
    assert packed.agg(F.sum("length")).first()[0] == want
    # run() is the stages, one after another
    ran = P.run(spark, SF)
    rows = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in df.collect())
    tokens = lambda df: {r["doc_id"]: r["doc_tokens"] for r in df.select("doc_id", "doc_tokens").collect()}
    assert ran.columns == packed.columns and tokens(ran) == tokens(packed) and sum(r[2] for r in rows(ran)) == want
