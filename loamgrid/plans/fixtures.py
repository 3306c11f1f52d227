"""Tables derived by arithmetic from the given ones, so that Spark and another engine can build the same.

The SQL below reads events, lineitem, supplier, region, nation and customer; it
uses nothing but integer arithmetic, CASE and VALUES.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rings as R

X0, Y0 = -2_000_000, 1_700_000
CELL = 600

# Outlines of the five soil shapes, as polygons of rings, in metres from their origin.
SHAPES = [
    [[[(0, 0), (300, 0), (300, 300), (0, 300), (0, 0)]]],
    [[[(0, 0), (300, 0), (300, 120), (120, 120), (120, 300), (0, 300), (0, 0)]]],
    [[[(0, 0), (300, 0), (300, 300), (0, 300), (0, 0)], [(90, 90), (210, 90), (210, 210), (90, 210), (90, 90)]]],
    [[[(0, 0), (120, 0), (120, 300), (0, 300), (0, 0)]], [[(180, 0), (300, 0), (300, 300), (180, 300), (180, 0)]]],
    [[[(150, -60), (360, 150), (150, 360), (-60, 150), (150, -60)]]],
]

_CODE = "CASE (({a}*31 + cast(floor({a}/200) as bigint)*17) % 12) WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 24 WHEN 3 THEN 36 WHEN 4 THEN 61 WHEN 5 THEN 64 WHEN 6 THEN 69 WHEN 7 THEN 75 WHEN 8 THEN 111 WHEN 9 THEN 152 WHEN 10 THEN 176 ELSE 9 END"

SQL = {
    "fx_points": f"SELECT event_id AS pixel_id, cast({X0} + 15 + 30*(event_id % 200) as int) AS x, cast({Y0} + 15 + 30*cast(floor(event_id/200) as bigint) as int) AS y, cast({_CODE.format(a='event_id')} as int) AS crop_code FROM events",
    "fx_points_skew": f"SELECT cast({X0} + 15 + 30*(CASE WHEN l_linenumber <= 3 THEN l_partkey % 10 ELSE (l_partkey*l_suppkey) % 200 END) as int) AS x, cast({Y0} + 15 + 30*(l_orderkey % (SELECT cast(floor(count(*)/200) as bigint) FROM events)) as int) AS y, cast({_CODE.format(a='l_partkey')} as int) AS crop_code FROM lineitem",
    "fx_soil": f"SELECT s_suppkey AS polygon_id, cast(100000 + s_suppkey % 37 as varchar(20)) AS mukey, concat('M', cast(s_suppkey % 11 as varchar(20))) AS musym, CASE WHEN s_suppkey % 7 = 0 THEN 'NV001' ELSE 'CA013' END AS areasymbol, {X0} + 300*(s_suppkey % 20) AS x0, {Y0} + 300*cast(floor(s_suppkey/20) as bigint) AS y0, s_suppkey % 5 AS shape FROM supplier",
    "fx_drought": f"SELECT r_regionkey AS drought_class, {X0} + 1200*r_regionkey AS minx, {Y0} AS miny, {X0} + 1200*r_regionkey + 1500 AS maxx, {Y0} + 30*(SELECT cast(floor(count(*)/200) as bigint) FROM events) AS maxy FROM region",
    "fx_attr": "SELECT cast(100000 + n_nationkey as varchar(20)) AS mukey, CASE WHEN n_nationkey % 2 = 0 THEN concat(n_name, '.') ELSE n_name END AS muname, nullif(n_nationkey % 9, 0) AS cap_rainfed, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey % 8 + 1 END AS cap_irrigated, CASE n_nationkey % 3 WHEN 0 THEN 'Well drained' WHEN 1 THEN 'Poorly drained' END AS drainage, CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey * cast(0.8 as double) END AS water_storage, CASE WHEN n_nationkey % 6 <> 0 THEN n_nationkey * cast(1.5 as double) END AS slope_pct FROM nation",
    "fx_raw_attr": "SELECT cast(100000 + s_suppkey as varchar(20)) AS mukey, concat(s_name, '.') AS muname, nullif(s_suppkey % 9, 0) AS cap_rainfed, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 8 + 1 END AS cap_irrigated, CASE s_suppkey % 3 WHEN 0 THEN 'Well drained' WHEN 1 THEN 'Poorly drained' END AS drainage, CASE WHEN s_suppkey % 5 <> 0 THEN (s_suppkey % 50) * cast(0.8 as double) END AS water_storage, CASE WHEN s_suppkey % 6 <> 0 THEN (s_suppkey % 60) * cast(1.5 as double) END AS slope_pct FROM supplier",
    "fx_fields": f"SELECT c_custkey AS field_id, {X0} + (c_custkey*137) % 6600 - 300 - h AS minx, {Y0} + (c_custkey*91) % (30*r + 600) - 300 - h AS miny, {X0} + (c_custkey*137) % 6600 - 300 + h AS maxx, {Y0} + (c_custkey*91) % (30*r + 600) - 300 + h AS maxy FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 100 WHEN 1 THEN 200 WHEN 2 THEN 400 WHEN 3 THEN 800 ELSE 1600 END AS h, (SELECT cast(floor(count(*)/200) as bigint) FROM events) AS r FROM customer) q",
    "fx_requests": "SELECT event_type AS phase, user_id % 5 AS run, value AS latency_ms, CASE WHEN event_id % 50 = 0 THEN 500 ELSE 200 END AS status, event_id % 2 = 0 AS cached FROM events",
}
# Corners and edges of the shapes for engines without arrays; rects: disjoint rectangles of shapes 0 to 3.
_EDGES = [(s, *a, *b) for s, shape in enumerate(SHAPES) for poly in shape for ring in poly for a, b in zip(ring, ring[1:])]
RECTS = [(0, 0, 0, 300, 300), (1, 0, 0, 300, 120), (1, 0, 120, 120, 300), (2, 0, 0, 300, 90), (2, 0, 210, 300, 300), (2, 0, 90, 90, 210), (2, 210, 90, 300, 210), (3, 0, 0, 120, 300), (3, 180, 0, 300, 300)]
SQL["fx_shape_edges"] = "SELECT * FROM (VALUES " + ", ".join(map(str, _EDGES)) + ") AS t(shape, ex1, ey1, ex2, ey2)"
SQL["fx_shape_rects"] = "SELECT * FROM (VALUES " + ", ".join(map(str, RECTS)) + ") AS t(shape, rx1, ry1, rx2, ry2)"

_TABLES = {"fx_points": ["events"], "fx_points_skew": ["events", "lineitem"], "fx_soil": ["supplier"], "fx_drought": ["events", "region"], "fx_attr": ["nation"], "fx_raw_attr": ["supplier"], "fx_fields": ["events", "customer"], "fx_requests": ["events"]}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table over the given folder's tables."""
    text = SQL[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES[name]}
    text = text.replace("varchar(20)", "string")
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **tables)


def _rings(shape: list, x0: Column, y0: Column) -> Column:
    return F.array(*[F.array(*[F.array(*[R.vertex(x0 + x, y0 + y) for x, y in ring]) for ring in poly]) for poly in shape])


def soil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_soil with its rings."""
    df = fixture(spark, sf_dir, "fx_soil")
    rings = F.coalesce(*[F.when(F.col("shape") == i, _rings(s, F.col("x0"), F.col("y0"))) for i, s in enumerate(SHAPES)])
    return df.withColumn("rings", rings)


def dented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square for each soil polygon whose lower side is pushed out in the middle: by 10 m where polygon_id is even, else by 50."""
    x, y = F.col("x0"), F.col("y0")
    out = F.when(F.col("polygon_id") % 2 == 0, 10).otherwise(50)
    ring = [R.vertex(x, y), R.vertex(x + 150, y - out), *(R.vertex(x + a, y + b) for a, b in ((300, 0), (300, 300), (0, 300), (0, 0)))]
    return fixture(spark, sf_dir, "fx_soil").withColumn("rings", F.array(F.array(F.array(*ring))))


def bordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer of neighbours: squares whose lower and upper sides are pushed down in the middle, by 10 m where the number of the one above is a multiple of 3, else by 50."""
    x, y = F.col("x0"), F.col("y0")
    out = lambda k: F.when(k % 3 == 0, 10).otherwise(50)
    low, high = out(F.col("polygon_id")), out(F.col("polygon_id") + 20)
    ring = [R.vertex(x, y), R.vertex(x + 150, y - low), R.vertex(x + 300, y), R.vertex(x + 300, y + 300), R.vertex(x + 150, y + 300 - high), R.vertex(x, y + 300), R.vertex(x, y)]
    return fixture(spark, sf_dir, "fx_soil").withColumn("rings", F.array(F.array(F.array(*ring))))


def drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drawing for each field, in units of its box: one good, the others each wrong in a way of its own (field_id % 10)."""
    x, y, h = F.col("minx"), F.col("miny"), (F.col("maxx") - F.col("minx")) / 10
    ring = lambda *at: F.array(*[R.vertex(x + h * a, y + h * b) for a, b in at])
    square = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    shapes = [
        F.array(F.array(ring(*square))),
        F.array(F.array(ring(*square[:3]))),  # too few positions
        F.array(F.array(ring(*square[:4]))),  # open
        F.array(F.array(ring((0, 0), (10, 10), (10, 0), (0, 10), (0, 0)))),  # bow-tie
        F.array(F.array(ring((0, 0), (10, 0), (10, 10), (5, 10), (5, 14), (5, 10), (0, 10), (0, 0)))),  # spike
        F.array(F.array(ring(*square), ring((12, 2), (14, 2), (14, 4), (12, 4), (12, 2)))),  # hole outside
        F.array(F.array(ring((0, 0), (5, 5), (10, 0), (10, 10), (5, 5), (0, 10), (0, 0)))),  # touches itself
        F.array(F.array(ring(*square)), F.array(ring((5, 5), (15, 5), (15, 15), (5, 15), (5, 5)))),  # parts overlap
        F.array(F.array(ring((0, 0), (2000, 0), (2000, 2000), (0, 2000), (0, 0)))),  # too large
        F.lit(None).cast(R.RINGS),
    ]
    kind = F.col("field_id") % len(shapes)
    picked = F.coalesce(*[F.when(kind == i, shape) for i, shape in enumerate(shapes[:-1])])
    return fixture(spark, sf_dir, "fx_fields").select("field_id", picked.alias("rings"))


def rectangles(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """fx_drought or fx_fields with their rings in place of the corners."""
    box = R.rectangle(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")])
    return fixture(spark, sf_dir, name).withColumn("rings", box).drop("minx", "miny", "maxx", "maxy")


def points(spark: SparkSession, sf_dir: str, skew: bool = False) -> DataFrame:
    return fixture(spark, sf_dir, "fx_points_skew" if skew else "fx_points")
