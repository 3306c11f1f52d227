"""Reading, writing, shaping and checking queries against their SQL on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loamgrid.functions import geometry as G
from loamgrid.operators import overlay as O
from loamgrid.plans import fixtures as X
from loamgrid.plans.oracles import ORACLES
from loamgrid.plans.queries import QUERIES
from loamgrid.sources import tables as T

SF = "/root/testdata/sf0.001"
NAMES = "point_files geometry_files wkt_round_trip swapped_axes published_overlay written_overlay clipped_soil soil_in_area footprint_coverage layer_classes prepared_soil simplify_impact simplified_soil answer_change field_statuses repaired_fields field_top_crops field_groups field_mapunits stride_sample key_batches attach_drought zone_area_share".split()


def rows(frame):
    plain = lambda v: "null" if pd.isna(v) else (v if isinstance(v, (bool, str)) or type(v).__name__ == "bool_" else round(float(v), 6))
    return sorted((tuple(str(plain(v)) for v in r) for r in frame[sorted(frame.columns)].astype(object).values.tolist()), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier lineitem events".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.execute(ORACLES[name]).df())


def test_sample_size(spark):
    n = QUERIES["fraction_sample"](spark, SF).count()
    assert 50 < n < 160


def test_wkt_reader(spark):
    texts = ["POLYGON ((0 0, 4 0, 4 3, 0 0))", "SRID=5070;MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5 9,6 5 9,6 6 9,5 5 9),(1e0 -1.5, 2 2, 3 3, 1 -1.5)))", "POINT (1 2)", None, "no text"]
    got = [r["r"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.from_wkt(F.col("t")).alias("r")).orderBy("i").collect()]
    assert [tuple(v) for v in got[0][0][0]] == [(0, 0), (4, 0), (4, 3), (0, 0)]
    assert len(got[1]) == 2 and tuple(got[1][1][1][0]) == (1.0, -1.5) and tuple(got[1][1][0][0]) == (5, 5)
    assert got[2:] == [None, None, None]


def circle(n, radius=1000.0, at=(0.0, 0.0)):
    t = np.linspace(0, 2 * np.pi, n + 1)
    ring = np.stack([at[0] + radius * np.cos(t), at[1] + radius * np.sin(t)], 1)
    ring[-1] = ring[0]
    return ring


def test_polygons_of_fifty_thousand_vertices():
    big, box = [[circle(50_000)]], [[np.array([(0, 0), (2000, 0), (2000, 2000), (0, 2000), (0, 0)], float)]]
    assert G.overlap_area(big, box) == pytest.approx(np.pi * 1e6 / 4, rel=1e-6)
    assert G.overlap_area(big, [[circle(20_000, 500.0)]]) == pytest.approx(np.pi * 25e4, rel=1e-6)
    assert G.intersects(big, box) and not G.intersects(big, [[circle(50_000, 10, (900, 900))]])
    assert not G.crosses_itself(big)
    assert G.crosses_itself([[np.insert(big[0][0], 10, [[0, 2000], [1, 2000]], 0), circle(100, 999.9999)]])


@pytest.mark.parametrize(
    "shape,bad",
    [
        ([[[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]]], False),
        ([[[(0, 0), (4, 0), (4, 0), (4, 4), (0, 4), (0, 0)]]], False),  # a repeated position
        ([[[(0, 0), (4, 0), (4, 4), (2, 4), (2, 6), (2, 4), (0, 4), (0, 0)]]], True),  # spike
        ([[[(0, 0), (4, 0), (4, 4), (2, 0), (0, 4), (0, 0)]]], True),  # a corner on its own edge
        ([[[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)]]], False),
        ([[[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(0, 0), (2, 1), (1, 2), (0, 0)]]], False),  # a hole that touches its outline
        ([[[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(5, 1), (6, 1), (6, 2), (5, 1)]]], True),
        ([[[(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(1, 1), (8, 1), (8, 8), (1, 8), (1, 1)], [(2, 2), (3, 2), (3, 3), (2, 2)]]], True),  # a hole in a hole
        ([[[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]], [[(4, 4), (6, 4), (6, 6), (4, 4)]]], False),  # parts that touch at a point
        ([[[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]], [[(4, 0), (6, 0), (6, 4), (4, 4), (4, 0)]]], True),  # that share an edge
        ([[[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]], [[(1, 1), (2, 1), (2, 2), (1, 1)]]], True),  # that lie in one another
    ],
)
def test_validity(shape, bad):
    assert G.crosses_itself([[np.array(r, float) for r in poly] for poly in shape]) == bad


def test_equal_polygons_keep_the_least_id(spark):
    soil = X.soil(spark, SF)
    twice = soil.unionByName(soil.withColumn("polygon_id", F.col("polygon_id") + 1000)).repartition(7)
    got = O.attach_drought(twice, X.rectangles(spark, SF, "fx_drought"), 3000)
    assert sorted(r[0] for r in got.select("polygon_id").collect()) == sorted(r[0] for r in soil.select("polygon_id").collect())
