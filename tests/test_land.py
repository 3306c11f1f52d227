"""Land queries against their SQL on the smallest tables, and golden values."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loamgrid.functions import legend
from loamgrid.functions import rings as R
from loamgrid.functions.albers import to_5070
from loamgrid.operators import fields, insight, overlay
from loamgrid.plans import fixtures
from loamgrid.plans.oracles import ORACLES
from loamgrid.plans.queries import QUERIES
from loamgrid.sources import tables

SF = "/root/testdata/sf0.001"

FAST = ["overlay", "overlay_broadcast", "overlay_chunked", "overlay_skew", "match_multiplicity", "scanline_truth", "class_histogram", "albers_projection", "mukey_area", "polygon_geometry", "latency_summary", "phase_summary", "valid_weeks", "square_fields", "clean_attributes", "raster_points", "field_hits", "consistency"]


def rows(frame):
    plain = lambda v: "null" if pd.isna(v) else (v if isinstance(v, (bool, str)) or type(v).__name__ == "bool_" else round(float(v), 6))
    return sorted((tuple(str(plain(v)) for v in r) for r in frame[sorted(frame.columns)].astype(object).values.tolist()), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier lineitem events".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, con, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.execute(ORACLES[name]).df())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_projection_golden(spark):
    x, y = to_5070(F.col("lon"), F.col("lat"))
    got = spark.createDataFrame([(-96.0, 23.0), (-119.852, 36.648)], "lon double, lat double").select(F.round(x, 3), F.round(y, 3)).collect()
    assert [tuple(abs(v) if v == 0 else v for v in r) for r in got] == [(0.0, 0.0), (-2090592.708, 1775058.933)]


def test_legend_golden(spark):
    c = F.col("c")
    got = spark.createDataFrame([(75,), (204,), (64,), (152,), (9,)], "c int").select(legend.land_cover_name(c)).collect()
    assert [r[0] for r in got] == ["Almonds", "Pistachios", "Shrubland", "Shrubland", None]
    got = spark.createDataFrame([(-1,), (2,), (7,)], "c int").select(legend.drought_label(c)).collect()
    assert [r[0] for r in got] == ["No drought", "D2 — Severe drought", "Unknown (7)"]


def test_field_status(spark):
    g = lambda pts: '{"type":"Polygon","coordinates":[[' + ",".join(f"[{x},{y}]" for x, y in pts) + "]]}"
    square = [(-119.852, 36.648), (-119.848, 36.648), (-119.848, 36.652), (-119.852, 36.652), (-119.852, 36.648)]
    drawn = {
        "ok": g(square), "short": g(square[:3]), "open": g(square[:4]), "bow": g([square[0], square[2], square[1], square[3], square[0]]),
        "huge": g([(-120, 36), (-119, 36), (-119, 37), (-120, 37), (-120, 36)]), "none": None, "point": '{"type":"Point","coordinates":[1,2]}', "empty": '{"type":"Polygon","coordinates":[]}',
    }
    df = spark.createDataFrame(list(drawn.items()), "field_id string, geojson string").withColumn("rings", tables.from_geojson(F.col("geojson")))
    got = {r["field_id"]: (r["status"], r["query_acres"]) for r in fields.validate_fields(df).collect()}
    assert got["ok"][0] == "ok" and got["ok"][1] == pytest.approx(39.2317, abs=1e-3)
    assert {k: v[0] for k, v in got.items()} == {"ok": "ok", "short": "bad_ring", "open": "bad_ring", "bow": "invalid", "huge": "too_large", "none": "bad_geometry", "point": "bad_geometry", "empty": "bad_ring"}


@pytest.mark.parametrize(
    "cultivable,farmed,headline",
    [(0.5, 0.5, insight.CAPABLE), (0.5, 0.19, insight.IDLE), (0.19, 0.19, insight.MARGINAL), (0.19, 0.5, insight.BEYOND), (0.3, 0.3, insight.MIXED), (None, 0.5, insight.NO_RATING)],
)
def test_headlines(spark, cultivable, farmed, headline):
    row = Row(coverage=0.9, rated_m2=0.0 if cultivable is None else 100.0, cultivable_m2=100.0 * (cultivable or 0), irrigable_m2=0.0, answered_m2=200.0, agricultural_share=farmed, slope_pct=31.0, water_storage=7.0, dominant_soil="Loam.", dominant_drainage="Well Drained", severe_share=0.3, drought_share=0.4)
    got = insight.insight(spark.createDataFrame([row])).first()
    assert got["headline"] == headline
    kinds = [f["kind"] for f in got["findings"]]
    assert kinds == (["caveat"] if cultivable is None else ["capability", "use", "irrigation", "drought", "terrain", "water", "caveat", "caveat"])


def test_join_uses_cells_not_a_cross_join(spark):
    joined = overlay.point_in_polygon_join(fixtures.points(spark, SF), fixtures.soil(spark, SF), 600, "partitioned")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_overlay_sample_keeps_its_own_folder(spark, tmp_path):
    df = QUERIES["overlay"](spark, SF)
    assert tables.write_overlay(df.limit(3), str(tmp_path / "o"), sampled=True).endswith("_sample")
    tables.publish(df.limit(5), str(tmp_path / "p"), "one")
    tables.publish(df.limit(4), str(tmp_path / "p"), "two")
    tables.publish(df.limit(2), str(tmp_path / "p"), "one")
    assert {r[0]: r[1] for r in spark.read.parquet(str(tmp_path / "p")).groupBy("aoi").count().collect()} == {"one": 2, "two": 4}


def test_geojson_round_trip(spark):
    ring = R.rectangle(F.lit(0.0), F.lit(0.0), F.lit(1.5), F.lit(2.0))
    df = spark.range(1).select(ring.alias("r")).withColumn("text", tables.to_geojson(F.col("r"))).withColumn("back", tables.from_geojson(F.col("text")))
    got = df.first()
    assert got["back"] == got["r"]
