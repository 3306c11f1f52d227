"""Simplification of layers: shared borders stay shared, holes stay inside, nothing folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.functions import geometry as G
from loamgrid.functions import rings as R
from loamgrid.operators.cover import meeting_pairs
from loamgrid.operators.simplify import simplify_arc, simplify_layer


def table(spark, shapes):
    return spark.createDataFrame([(i, "u", s) for i, s in enumerate(shapes)], f"polygon_id long, mukey string, rings {R.RINGS}")


def simple(spark, shapes, tolerance):
    got = simplify_layer(table(spark, shapes), tolerance).collect()
    return {r["polygon_id"]: r["rings"] and [[np.array([tuple(p) for p in ring]) for ring in poly] for poly in r["rings"]] for r in got}


def area(shape):
    return sum((1 if k == 0 else -1) * abs((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum()) / 2 for p in shape for k, r in enumerate(p))


def wavy_grid(n, seed):
    """n x n neighbours whose common borders are wavy lines of the same vertices."""
    rng = np.random.default_rng(seed)
    corner = {(i, j): (100.0 * i + rng.integers(-15, 15), 100.0 * j + rng.integers(-15, 15)) for i in range(n + 1) for j in range(n + 1)}

    def line(a, b):
        p, q = np.array(corner[a]), np.array(corner[b])
        t = np.linspace(0, 1, 12)[:, None]
        off = rng.integers(-4, 5, (12, 2)) * ((t > 0) & (t < 1))
        return [tuple(map(float, v)) for v in np.rint(p + t * (q - p)) + off]

    across = {(i, j): line((i, j), (i + 1, j)) for i in range(n) for j in range(n + 1)}
    up = {(i, j): line((i, j), (i, j + 1)) for i in range(n + 1) for j in range(n)}
    return [[[across[i, j][:-1] + up[i + 1, j][:-1] + across[i, j + 1][::-1][:-1] + up[i, j][::-1]]] for i in range(n) for j in range(n)]


@pytest.mark.parametrize("tolerance", [3.0, 12.0, 60.0])
def test_neighbours_stay_without_gaps_or_overlaps(spark, tolerance):
    shapes = wavy_grid(4, 2)
    whole = [[[np.array(r) for r in p] for p in s] for s in shapes]
    assert not any(map(G.crosses_itself, whole))
    got = simple(spark, shapes, tolerance)
    assert not any(map(G.crosses_itself, got.values()))
    count = lambda all_: sum(len(r) for s in all_ for p in s for r in p)
    assert count(got.values()) < count(whole) / (1 if tolerance < 5 else 3)
    left = spark.createDataFrame([(i, [[[tuple(map(float, v)) for v in r] for r in p] for p in s]) for i, s in got.items()], f"a long, rings {R.RINGS}")
    shared = {(r["a"], r["b"]): r["m2"] for r in meeting_pairs(left, left.withColumnRenamed("a", "b"), 50.0, "a", "b").collect()}
    assert all(m2 == pytest.approx(area(got[a]) if a == b else 0, abs=1e-6) for (a, b), m2 in shared.items())
    # who touches whom stays, and each border is one line: what one ring has, the neighbour has turned round
    assert {k for k in shared} == {(r["a"], r["b"]) for r in meeting_pairs(*(table(spark, shapes).select(F.col("polygon_id").alias(n), "rings") for n in "ab"), 50.0, "a", "b").collect()}
    edges = [tuple(map(tuple, e.reshape(2, 2).tolist())) for s in got.values() for e in G.edges_of(s)]
    outer = [e for e in edges if e[::-1] not in set(edges)]
    assert len(edges) == len(set(edges)) and abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in outer)) / 2 == pytest.approx(sum(map(area, got.values())))


def test_a_hole_near_its_outline_stays_inside(spark):
    bump = [(0, 0), (100, 0), (100, 100), (60, 100), (50, 112), (40, 100), (0, 100), (0, 0)]
    hole = [(48, 102), (52, 102), (50, 106), (48, 102)]
    ring = lambda r: [tuple(map(float, p)) for p in r]
    got = simple(spark, [[[ring(bump), ring(hole)]], [[ring([(x + 500, y) for x, y in bump])]]], 20.0)
    assert len(got[0][0]) == 2 and not G.crosses_itself(got[0]) and (50.0, 112.0) in {*map(tuple, got[0][0][0])}
    assert len(got[1][0][0]) == 5  # without a hole the bump goes


def test_nothing_folds(spark):
    ring = lambda *r: [tuple(map(float, p)) for p in r]
    lens = [ring((0, 0), (50, -4), (100, 0), (50, 5), (0, 0))]
    above = [ring((0, 0), (50, 5), (100, 0), (100, 90), (0, 90), (0, 0))]
    below = [ring((0, 0), (0, -90), (100, -90), (100, 0), (50, -4), (0, 0))]
    small = [ring((300, 0), (301, 0), (301, 1), (300, 1), (300, 0))]
    got = simple(spark, [[lens], [above], [below], [small], None, []], 30.0)
    assert got[4] is None and got[5] == []
    assert all(not G.crosses_itself(got[k]) and area(got[k]) > 0 for k in range(4))
    assert simplify_layer(table(spark, [[lens]]), 0.0).count() == 1
    assert simplify_layer(table(spark, []), 30.0).collect() == []


def test_an_arc_keeps_what_lies_beside_it():
    arc = np.array([(0, 0), (10, 3), (20, 4), (30, 3), (40, 0)], float)
    assert simplify_arc(arc, np.zeros((0, 2)), 5.0).tolist() == [True, False, False, False, True]
    assert simplify_arc(arc, np.array([(20.0, 2.0)]), 5.0).sum() > 2
    assert simplify_arc(arc, np.array([(20.0, 5.0)]), 5.0).sum() == 2
