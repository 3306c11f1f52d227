"""Land queries over whole tables: nothing is left out by shape, key, box or cap."""

import duckdb
import pytest
from pyspark.sql import functions as F

from loamgrid.functions import rings as R
from loamgrid.operators import fields as FL
from loamgrid.plans import fixtures as X
from loamgrid.plans.oracles import ORACLES
from loamgrid.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def clip_area(ring, box):
    """Square metres of a convex or simple ring within a box, by cutting at each side of the box."""
    for axis, bound, keep in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        out = []
        for p, q in zip(ring, ring[1:] + ring[:1]):
            inside_p, inside_q = keep * (p[axis] - bound) >= 0, keep * (q[axis] - bound) >= 0
            if inside_p:
                out.append(p)
            if inside_p != inside_q:
                t = (bound - p[axis]) / (q[axis] - p[axis])
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        ring = out
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1]))) / 2


def brute_hits(spark):
    """Square metres of each field and map unit, over every soil polygon."""
    soil = X.fixture(spark, SF, "fx_soil").collect()
    got = {}
    for f in X.fixture(spark, SF, "fx_fields").collect():
        for s in soil:
            box = (f["minx"] - s["x0"], f["miny"] - s["y0"], f["maxx"] - s["x0"], f["maxy"] - s["y0"])
            if box[0] > 360 or box[1] > 360 or box[2] < -60 or box[3] < -60:
                continue
            m2 = sum(clip_area(poly[0][:-1], box) - sum(clip_area(hole[:-1], box) for hole in poly[1:]) for poly in X.SHAPES[s["shape"]])
            if m2 > 0:
                key = (f["field_id"], s["mukey"])
                got[key] = got.get(key, 0) + m2
    return got


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier lineitem events".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_field_hits_count_every_polygon(spark):
    got = {(r["field_id"], r["mukey"]): r["inter_m2"] for r in QUERIES["field_hits"](spark, SF).collect() if r["inter_m2"] > 0}
    want = brute_hits(spark)
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 2e-3 for k in want)


@pytest.mark.parametrize("name", ["scanline_truth", "validate_overlay"])
def test_row_spans_cover_sloped_edges(spark, con, name):
    sql = ORACLES[name].replace("FROM hit WHERE shape < 4", "FROM hit")
    out = QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({sql})").fetchall()
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))


def test_tiles_cover_every_outline(spark):
    boxes = X.fixture(spark, SF, "fx_fields").select("minx", "miny", "maxx", "maxy").collect()
    x0, y0 = min(b["minx"] for b in boxes), min(b["miny"] for b in boxes)
    want = set()
    for b in boxes:
        # a tile is closed: an outline that ends on its side touches it
        for col in range((b["minx"] - x0 - 1) // 1000, (b["maxx"] - x0) // 1000 + 1):
            for row in range((b["miny"] - y0 - 1) // 1000, (b["maxy"] - y0) // 1000 + 1):
                if x0 + col * 1000 < max(o["maxx"] for o in boxes) and y0 + row * 1000 < max(o["maxy"] for o in boxes):
                    want.add((row, col))
    want = {t for t in want if min(t) >= 0}
    got = [tuple(r) for r in QUERIES["tiles_for_aoi"](spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_land_queries_use_the_operators_own_limits(spark):
    ranked = QUERIES["field_mapunits"](spark, SF).collect()
    hits = {k for k in brute_hits(spark)}
    assert not any(r["truncated"] for r in ranked)
    assert {(r["field_id"], r["mukey"]) for r in ranked} <= hits and max(r["rn"] for r in ranked) > 5
    crops = QUERIES["field_top_crops"](spark, SF).collect()
    assert max(r["rn"] for r in crops) == 8


def test_truncation_is_told(spark):
    overlay = spark.createDataFrame([(str(u), "M", "CA", 1, -1, 10, 2.0, "Corn", True) for u in range(3)], "mukey string, musym string, areasymbol string, crop_code int, drought_class int, pixels long, acres double, land_cover string, is_agricultural boolean")
    square = lambda a, b: R.rectangle(F.lit(float(a)), F.lit(0.0), F.lit(float(b)), F.lit(10.0))
    soil = spark.range(3).select(F.col("id").alias("polygon_id"), F.col("id").cast("string").alias("mukey"), R.rectangle(F.col("id") * 10.0, F.lit(0.0), F.col("id") * 10.0 + 10.0, F.lit(10.0)).alias("rings"))
    fields = spark.range(1).select(F.lit(7).alias("field_id"), square(0, 25).alias("rings"))
    attrs = spark.createDataFrame([], "mukey string, muname string")
    for cap, units in ((2, 2), (3, 3)):
        got = FL.area_mapunits(FL.field_pairs(fields, soil, 50), fields, soil, overlay, attrs, cap).collect()
        assert len(got) == units and all(r["truncated"] == (cap < 3) for r in got)
