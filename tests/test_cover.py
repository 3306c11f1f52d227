"""Adaptive covers: points, areas and touches by tiles against whole shapes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.functions import geometry as G
from loamgrid.functions import rings as R
from loamgrid.functions import tiles as T
from loamgrid.operators import overlay as O
from loamgrid.operators.cover import meeting_pairs, pair_cover, point_cover


def star(rng, n, x, y, r, whole):
    turn = np.sort(rng.random(n)) * 2 * np.pi
    far = r * (0.4 + 0.6 * rng.random(n))
    p = np.stack([x + far * np.cos(turn), y + far * np.sin(turn)], 1)
    p = np.rint(p) if whole else p
    return np.vstack([p, p[:1]])


BOX = [(0, 0), (80, 0), (80, 80), (0, 80), (0, 0)]
HOLED = [[np.array(BOX, float), np.array([(20, 20), (60, 20), (60, 60), (20, 60), (20, 20)], float)], [np.array([(160, 0), (240, 0), (240, 160), (160, 160), (160, 0)], float)]]


def area(shape):
    return sum((1 if k == 0 else -1) * abs((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum()) / 2 for p in shape for k, r in enumerate(p))


def answers(cover, points):
    """For each (point, shape) what the tile that holds the point says; no pair has two tiles."""
    found = {}
    for level in {*cover.inner, *cover.border}:
        side = cover.side(level)
        at = {}
        for i, (x, y) in enumerate(points):
            at.setdefault((math.floor(x / side), math.floor(y / side)), []).append(i)
        for o, ix, iy in zip(*cover.inner.get(level, ((), (), ()))):
            for i in at.get((ix, iy), ()):
                assert found.setdefault((i, o), True) is True
        if level in cover.border:
            t = cover.border[level]
            known = cover.known(t, side)
            for k in range(len(t)):
                i = np.array(at.get((t.ix[k], t.iy[k]), []), int)
                if len(i):
                    e = cover.edges[t.edge[t.tile == k]]
                    inside = T.inside_tiles(np.tile(e, (len(i), 1)), np.repeat(np.arange(len(i)), len(e)), np.full(len(i), known[k]), np.full(len(i), (t.ix[k] + 1) * side), points[i, 0], points[i, 1])
                    for a, b in zip(i.tolist(), inside.tolist()):
                        assert (a, t.owner[k]) not in found
                        found[a, t.owner[k]] = b
    return {k for k, v in found.items() if v}


@pytest.mark.parametrize("seed", range(12))
def test_tiles_answer_as_whole_shapes(seed):
    rng = np.random.default_rng(seed)
    shapes = [[[star(rng, int(rng.integers(3, 40)), *rng.integers(-200, 200, 2), rng.integers(20, 400), seed % 2 == 0)]] for _ in range(3)] + [HOLED]
    cover = T.Cover(G.Shapes(G.pack(shapes)), float(rng.choice([40, 16, 100])), most=int(rng.choice([2, 5, 16])))
    grid = np.stack(np.meshgrid(np.arange(-80, 320, 20.0), np.arange(-80, 320, 20.0)), -1).reshape(-1, 2)
    points = np.unique(np.concatenate([rng.integers(-620, 620, (700, 2)).astype(float), grid, *(r for s in shapes for p in s for r in p)]), axis=0)
    got = answers(cover, points)
    for o, shape in enumerate(shapes):
        e = G.edges_of(shape)
        up = np.where((e[:, 1] > e[:, 3])[:, None], e[:, [2, 3, 0, 1]], e)
        on = np.any([T.on_edge(np.tile(x, (len(points), 1)), points[:, 0], points[:, 1]) for x in up], axis=0)
        assert {i for i, owner in got if owner == o} == set(np.flatnonzero(G.inside(e, points) & ~on).tolist())


@pytest.mark.parametrize("seed", range(6))
def test_pieces_add_up_to_the_area(seed):
    rng = np.random.default_rng(seed)
    shapes = [[[star(rng, 30, 0, 0, 500, seed % 2 == 0)]], HOLED]
    cover = T.Cover(G.Shapes(G.pack(shapes)), 40.0, 1 << 40, 0)
    total = sum(np.bincount(o, minlength=2) * cover.side(level) ** 2 for level, (o, _, _) in cover.inner.items())
    tile, p = cover.pieces(cover.border[0])
    total = total + np.bincount(cover.border[0].owner[tile], p[:, 4] * (p[:, 1] - p[:, 0]) * (p[:, 2] + p[:, 3]) / 2, 2)
    assert total == pytest.approx([area(s) for s in shapes], rel=1e-9)


def test_a_large_polygon_is_listed_by_its_border(spark):
    """50,000 vertices over 10,000 cells: tiles and edges follow the border, not cells times edges."""
    turn = np.linspace(0, 2 * np.pi, 50_001)
    ring = np.stack([30_000 * np.cos(turn), 30_000 * np.sin(turn)], 1)
    ring[-1] = ring[0]
    shape = spark.createDataFrame([(1, [[[(float(x), float(y)) for x, y in ring]]])], f"polygon_id long, rings {R.RINGS}")
    cover = point_cover(shape, 600.0).select("level", "n_edges").toPandas()
    assert cover["n_edges"].sum() < 2 * 50_000 and cover["n_edges"].max() <= 32
    assert len(cover[cover["level"] >= 0]) < 3_000  # of 10,000 cells
    pairs = pair_cover(shape, "polygon_id", 600.0).agg(F.count("*"), F.sum(F.size("edges") / 4), F.sum("m2")).first()
    assert pairs[0] < 3_000 and pairs[1] < 1.1 * 50_000 and pairs[2] == pytest.approx(np.pi * 9e8, rel=1e-6)
    r = random.Random(1)
    points = [(i, r.randrange(-31_000, 31_000), r.randrange(-31_000, 31_000)) for i in range(20_000)]
    df = spark.createDataFrame(points, "pixel_id long, x int, y int")
    for strategy in ("broadcast", "partitioned"):
        got = {x["pixel_id"] for x in O.point_in_polygon_join(df, shape, 600.0, strategy).select("pixel_id").collect()}
        sure = {i for i, x, y in points if x * x + y * y < 29_999.9**2}
        assert sure <= got <= {i for i, x, y in points if x * x + y * y <= 9e8}


@pytest.mark.parametrize("cell", [37.0, 200.0, 5000.0])
def test_pairs_against_whole_shapes(spark, cell):
    rng = np.random.default_rng(int(cell))
    shapes = [[[star(rng, int(rng.integers(3, 14)), *rng.integers(-600, 600, 2), rng.integers(30, 300), True)]] for _ in range(60)]
    shapes = [s for s in shapes if not G.crosses_itself(s)] + [HOLED, [[np.array(BOX, float) + (80, 0)]], [[np.array(BOX, float) + (80, 80)]], [[np.array(BOX, float) * 40 - 1600]], [[np.array(BOX, float) / 4 + 30]]]
    half = len(shapes) // 2
    table = lambda some, name: spark.createDataFrame([(i, [[[(float(x), float(y)) for x, y in r] for r in p] for p in s]) for i, s in some], f"{name} long, rings {R.RINGS}")
    left, right = list(enumerate(shapes))[: half + 8], list(enumerate(shapes))[half - 8 :]
    got = {(r["a"], r["b"]): r["m2"] for r in meeting_pairs(table(left, "a"), table(right, "b"), cell, "a", "b").collect()}
    want = {(i, j): G.overlap_area(s, t) for i, s in left for j, t in right if G.intersects(s, t)}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], rel=1e-7, abs=1e-4) for k in want)


def test_missing_and_empty_shapes_cover_nothing(spark):
    shapes = spark.createDataFrame([(1, None), (2, []), (3, [[]]), (4, [[[]]]), (5, [[[(0.0, 0.0)]]])], f"polygon_id long, rings {R.RINGS}")
    points = spark.createDataFrame([(1, 0, 0), (2, None, 1)], "pixel_id long, x int, y int")
    assert O.point_in_polygon_join(points, shapes, 10.0).collect() == []
    assert meeting_pairs(shapes, shapes.withColumnRenamed("polygon_id", "b"), 10.0, "polygon_id", "b").collect() == []
    assert O.point_in_polygon_join(points.limit(0), shapes.limit(0), 10.0).collect() == []


def test_a_broadcast_beyond_its_limit_is_refused(spark):
    assert O.choose_strategy(10, 20, 30) == "broadcast" and O.choose_strategy(10, 20, 30, "partitioned") == "partitioned"
    for size in ((250_001, 300_000, 30), (10, 2_000_001, 30), (10, 20, 5_000_001)):
        assert O.choose_strategy(*size) == "partitioned"
        with pytest.raises(ValueError, match="too many"):
            O.choose_strategy(*size, "broadcast")
