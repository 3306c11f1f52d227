"""Global numbering over ranges: exact at any number of rows, columns and ranges."""

import random

import pytest
from pyspark.sql import functions as F

from loamgrid.operators.prepare import key_batches
from loamgrid.operators.reports import numbered, stride_sample


@pytest.mark.parametrize("rows,ranges", [(200_000, 7), (1_000, 4), (1, 4), (0, 4)])
def test_every_row_has_its_place(spark, rows, ranges):
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    df = spark.range(rows).select(((F.col("id") * 7919) % 1_000_003).alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    got = numbered(df, ["k"], "rn").orderBy("rn").toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = sorted(((i * 7919) % 1_000_003, f"v{i}") for i in range(rows))
    assert got["rn"].tolist() == list(range(rows))
    assert list(zip(got["k"], got["v"])) == want


def test_three_million_rows(spark):
    df = spark.range(3_000_000).select(F.xxhash64("id").alias("k"), (F.col("id") % 5).alias("v"), F.col("id"))
    found = numbered(df, ["k"], "rn").agg(F.count("*"), F.countDistinct("rn"), F.min("rn"), F.max("rn"), F.countDistinct("id")).first()
    assert tuple(found) == (3_000_000, 3_000_000, 0, 2_999_999, 3_000_000)


def test_ties_and_nulls_keep_a_place(spark):
    values = [None, 3, 3, 3, None, 1]
    got = numbered(spark.createDataFrame([(v,) for v in values], "k int"), ["k"], "rn").orderBy("rn").collect()
    assert [r["k"] for r in got] == [None, None, 1, 3, 3, 3]


def test_strides_and_batches_of_a_large_table(spark):
    keys = random.Random(5).sample(range(10**7), 200_000)
    df = spark.createDataFrame([(k, str(k)) for k in keys], "k long, mukey string").repartition(6)
    got = [r["k"] for r in stride_sample(df, ["k"], 7).collect()]
    assert got == sorted(keys)[:: 200_000 // 7][:7]
    batches = key_batches(df.select("mukey"), 500).orderBy("batch").collect()
    text = sorted(map(str, keys))
    assert [r["keys"] for r in batches] == [text[i : i + 500] for i in range(0, len(text), 500)]
