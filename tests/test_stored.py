"""Tables that a first run leaves and later runs read: answers by drawing, pixels by polygon; ranks from counts."""

import random
import statistics

from pyspark.sql import functions as F

from loamgrid.functions import rings as R
from loamgrid.operators import fields as FL
from loamgrid.operators import overlay as O
from loamgrid.operators import reports as RP
from loamgrid.sources import tables as T


def squares(spark, ids, size=10.0):
    x = F.col("id") * 7.0
    return spark.createDataFrame([(i,) for i in ids], "id long").select(F.col("id").alias("field_id"), R.rectangle(x, F.lit(0.0), x + size, F.lit(10.0)).alias("rings"))


def test_a_second_run_answers_nothing_anew(spark):
    path = T.shared_folder(spark, "answers")
    soil = spark.range(20).select(F.col("id").alias("polygon_id"), (F.col("id") % 3).cast("string").alias("mukey"), R.rectangle(F.col("id") * 10.0, F.lit(0.0), F.col("id") * 10.0 + 10.0, F.lit(10.0)).alias("rings"))
    asked = []

    def answer(new):
        asked.append(new.count())
        return FL.field_hits(FL.field_pairs(new, soil, 25.0))

    rows = lambda df: sorted((r["field_id"], r["mukey"], round(r["inter_m2"], 6)) for r in df.collect())
    first = rows(FL.stored_answers(squares(spark, [1, 2, 3]).unionByName(squares(spark, [2]).withColumn("field_id", F.lit(99).cast("long"))), path, answer))
    assert asked == [3] and {r[0] for r in first} == {1, 2, 3, 99}  # the same drawing under two ids is one
    again = FL.stored_answers(squares(spark, [1, 2, 3]), path, answer)
    assert asked == [3] and rows(again) == [r for r in first if r[0] != 99]
    assert "Arrow" not in again._jdf.queryExecution().toString()  # nothing spatial is left in the plan
    more = rows(FL.stored_answers(squares(spark, [3, 4]), path, answer))
    assert asked == [3, 1] and more == rows(FL.field_hits(FL.field_pairs(squares(spark, [3, 4]), soil, 25.0)))
    assert spark.read.parquet(path).select("run").distinct().count() == 2


def test_counts_are_published_once(spark):
    path = T.shared_folder(spark, "counts")
    soil = squares(spark, range(5)).withColumnRenamed("field_id", "polygon_id").withColumn("mukey", F.lit("a"))
    points = spark.range(40).select(F.col("id").cast("int").alias("x"), F.lit(5).alias("y"), (F.col("id") % 2).cast("int").alias("crop_code"))
    first = O.stored_counts(points, soil, path, 20.0)
    later = O.stored_counts(points.filter("1 = 0"), soil, path, 20.0)  # its points are not read any more
    want = sorted((r["polygon_id"], r["crop_code"], r["pixels"]) for r in O.polygon_crop_counts(points, soil, 20.0).collect())
    for df in (first, later):
        assert sorted((r["polygon_id"], r["crop_code"], r["pixels"]) for r in df.collect()) == want and want


def test_a_version_follows_the_files(spark):
    path = T.shared_folder(spark, "versions")
    spark.range(3).write.parquet(path)
    one = T.table_version(spark.read.parquet(path))
    assert one == T.table_version(spark.read.parquet(path))
    spark.range(2).write.mode("append").parquet(path)
    assert one != T.table_version(spark.read.parquet(path))


def test_ranks_from_counts(spark):
    r = random.Random(2)
    rows = [("a", run, float(r.choice([1, 2.5, 2.504, 7, 9.126]) if run % 2 else r.random() * 100), 500 if r.random() < 0.2 else 200, r.random() < 0.5) for run in range(4) for _ in range([1, 2, 57, 300][run])] + [("b", 1, 3.0, 500, True)]
    got = {(x["phase"], x["run"]): x for x in RP.latency_summary(spark.createDataFrame(rows, "phase string, run int, latency_ms double, status int, cached boolean")).collect()}
    for key in {(p, n) for p, n, *_ in rows}:
        good = sorted(v for p, n, v, s, _ in rows if (p, n) == key and s == 200)
        assert got[key]["ok"] == len(good)
        if good:
            rank = lambda p: good[max(1, min(len(good), round(p / 100 * len(good) + 0.5))) - 1]  # noqa: B023, E731
            for name, value in (("p50_ms", statistics.median(good)), ("p95_ms", rank(95)), ("p99_ms", rank(99)), ("min_ms", good[0]), ("max_ms", good[-1])):
                assert abs(got[key][name] - value) <= 0.0051
        else:
            assert got[key]["p50_ms"] is None
