"""Clipping many pairs at once against one by one."""

import numpy as np
import pytest

from loamgrid.functions import geometry as G
from loamgrid.functions.albers import to_4326
from loamgrid.plans.fixtures import SHAPES


def square(x, y, half):
    return [[np.array([(x - half, y - half), (x + half, y - half), (x + half, y + half), (x - half, y + half), (x - half, y - half)], float)]]


def star(rng, x, y, size):
    turn = np.sort(rng.uniform(0, 2 * np.pi, int(rng.integers(3, 100))))
    r = rng.uniform(0.3, 1, len(turn)) * size
    p = np.stack([x + r * np.cos(turn), y + r * np.sin(turn)], 1)
    return [[np.vstack([p, p[:1]])]]


def soil(k, x, y):
    return [[np.array([(x + a, y + b) for a, b in ring], float) for ring in poly] for poly in SHAPES[k % 5]]


def same(a, b):
    if a is None or b is None:
        return a is b
    return len(a) == len(b) and all(len(p) == len(q) and all(r.shape == s.shape and np.allclose(r, s, rtol=0, atol=1e-6) for r, s in zip(p, q)) for p, q in zip(a, b))


def pairs(seed, n=250):
    rng = np.random.default_rng(seed)
    for k in range(n):
        x, y = -2_000_000 + 300 * int(rng.integers(20)), 1_700_000 + 300 * int(rng.integers(20))
        at = rng.integers(-500, 800, 2) if k % 2 else rng.integers(-15, 25, 2) * 30  # on a grid many edges lie on one another
        other = star(rng, x + at[0], y + at[1], 500) if k % 3 == 2 else square(x + at[0], y + at[1], int(rng.choice([60, 100, 200, 800])))
        yield soil(k, x, y), other
    yield None, soil(0, 0, 0)
    yield soil(1, 0, 0), None
    yield [], soil(2, 0, 0)
    yield soil(2, 0, 0), []
    yield soil(2, 0, 0), soil(2, 0, 0)


@pytest.mark.parametrize("seed", range(4))
def test_rows_together_as_one_by_one(seed, monkeypatch):
    a, b = zip(*pairs(seed))
    want = [None if x is None or y is None else G.overlap(x, y) for x, y in zip(a, b)]
    cut, one = [], G.overlap
    monkeypatch.setattr(G, "overlap", lambda x, y: cut.append(len(G.edges_of(x)) + len(G.edges_of(y))) or one(x, y))
    got = G.unpack(G.overlaps(G.pack(list(a)), G.pack(list(b))))
    assert all(same(x, y) for x, y in zip(want, got))
    assert min(cut, default=1000) > 128 or not cut  # only shapes of many edges are cut alone


def test_no_rows():
    assert len(G.overlaps(G.pack([]), G.pack([]))) == 0


def test_degrees_of_arrays_are_those_of_columns(spark):
    from loamgrid.functions import rings as R

    made = soil(2, -2_000_000, 1_700_000) + soil(3, 300_000, 900_000)
    df = spark.createDataFrame([(1, [[[tuple(map(float, p)) for p in ring] for ring in poly] for poly in made]), (2, None)], f"k int, rings {R.RINGS}")
    got = df.select("k", G.in_degrees("rings").alias("a"), R.project(df.rings, inverse=True).alias("b")).orderBy("k").collect()
    assert got[1].a is None and got[1].b is None
    flat = lambda shape: [[len(r) for r in poly] for poly in shape]
    assert flat(got[0].a) == flat(got[0].b)
    assert np.allclose([tuple(p) for poly in got[0].a for r in poly for p in r], [tuple(p) for poly in got[0].b for r in poly for p in r], rtol=0, atol=1e-10)
    assert abs(float(to_4326(np.zeros(1), np.zeros(1), np)[0][0]) + 96) < 1e-12
