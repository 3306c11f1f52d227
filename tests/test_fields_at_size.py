"""What field answers do once for a field and unit, and not for each of many rows."""

import re

from pyspark.sql import functions as F

from loamgrid.functions import rings as R
from loamgrid.operators import fields as FL


def plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def squares(spark, n, side, key):
    at = F.col("id") * 10
    box = R.rectangle(at.cast("double"), F.lit(0.0), (at + side).cast("double"), F.lit(float(side)))
    return spark.range(n).select(F.col("id").alias(key), F.concat(F.lit("u"), F.col("id") % 3).alias("mukey"), box.alias("rings"))


WEIGHTED = [(1, "u0", 10.0, 0.5), (1, "u1", 4.0, 0.25), (2, "u1", 8.0, 0.5), (3, "u2", 1.0, None)]
OVERLAY = [(u, c, d, float(10 * c + d + 2), c + 3) for u in ("u0", "u1", "u2") for c in (1, 2, 5) for d in (-1, 0, 3)] + [("u0", None, 3, 7.0, 2)]


def tables(spark):
    overlay = spark.createDataFrame(OVERLAY, "mukey string, crop_code int, drought_class int, acres double, pixels long")
    overlay = overlay.withColumn("land_cover", F.concat(F.lit("c"), "crop_code")).withColumn("is_agricultural", F.col("crop_code") > 1)
    return spark.createDataFrame(WEIGHTED, "field_id long, mukey string, inter_m2 double, fraction double"), overlay


def test_a_field_meets_the_sums_of_a_unit(spark):
    weighted, overlay = tables(spark)
    df = FL.area_breakdown(weighted, overlay)
    want = {}
    for field, unit, _, share in WEIGHTED:
        for u, crop, dry, acres, pixels in OVERLAY:
            if u == unit:
                for k in ((field, "cover", crop, None), (field, "drought", None, dry)):
                    a, p = want.get(k, (None, None))
                    want[k] = (a, p) if share is None else ((a or 0) + acres * share, (p or 0) + pixels * share)
    got = {(r.field_id, r.row_kind, r.crop_code, r.drought_class): (r.acres, r.pixels) for r in df.collect()}
    near = lambda t: {k: tuple(None if x is None else round(x, 9) for x in v) for k, v in t.items()}
    assert near(got) == near(want)
    assert "Expand" not in plan(df)  # fields are joined with units' sums, and not copied for each grouping


def test_a_filter_looks_at_each_field_once(spark):
    df = FL.validate_fields(squares(spark, 9, 8, "field_id"), projected=True).filter("status = 'ok'")
    assert df.count() == 9
    assert len(re.findall(r"self_crossing\(", plan(df))) == 1


def test_pairs_of_a_field_lie_together(spark):
    fields, soil = squares(spark, 9, 15, "field_id"), squares(spark, 12, 10, "polygon_id")
    pairs = FL.field_pairs(fields, soil, 20)
    assert pairs.groupBy("field_id").count().filter("count > 1").count() == 9
    by = FL.field_hits(pairs).groupBy("field_id").agg(F.sum("inter_m2"))
    assert len(re.findall(r"Exchange hashpartitioning\([^)]*field_id", plan(by, "executedPlan"))) == 1


def test_a_response_adds_up_without_a_window(spark):
    weighted, overlay = tables(spark)
    fields = spark.createDataFrame([(1, 3.0), (2, 2.0), (3, 2.0), (4, 1.0)], "field_id long, query_acres double")
    attrs = spark.createDataFrame([("u0", "a.", 2, 3, "Well drained", 3.0, 5.0)], "mukey string, muname string, cap_rainfed int, cap_irrigated int, drainage string, water_storage double, slope_pct double")
    breakdown = FL.area_breakdown(weighted, overlay)
    df = FL.area_response(fields, FL.field_totals(weighted, overlay, fields), FL.soil_summary(weighted, overlay, attrs), breakdown)
    got = {r.field_id: r for r in df.collect()}
    cover = {k: [(x.crop_code, x.acres, x.share) for x in got[k].breakdown] for k in (1, 2)}
    total = sum(10 * c + d + 2 for c in (1, 2, 5) for d in (-1, 0, 3)) * 0.5
    assert cover[2] == [(c, round(a, 3), round(a / total, 4)) for c in (5, 2, 1) for a in [sum(10 * c + d + 2 for d in (-1, 0, 3)) * 0.5]]
    assert got[2].agricultural_share == (total - 0.5 * sum(10 + d + 2 for d in (-1, 0, 3))) / total
    assert len(cover[1]) == 4 and cover[1][-1][0] is None
    assert got[4].breakdown is None and got[4].coverage == 0
    assert "Window" not in plan(df)
