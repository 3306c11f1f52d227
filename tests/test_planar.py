"""Clipped and repaired outlines: valid, of the right area, and vertex by vertex where they can be written down."""

import numpy as np
import pytest
from test_cover import BOX, HOLED, area, star

from loamgrid.functions import geometry as G
from loamgrid.plans.fixtures import SHAPES


def rings(shape):
    """Polygons as sorted lists of rings, each without its repeated end, from its least vertex on to the lesser neighbour."""

    def ring(r):
        p = [tuple(map(float, v)) for v in r[:-1]]
        k = p.index(min(p))
        p = p[k:] + p[:k]
        return min(p, p[:1] + p[:0:-1])

    return sorted([ring(poly[0]), *sorted(map(ring, poly[1:]))] for poly in shape)


def shape_of(k):
    return [[np.array(r, float) for r in poly] for poly in SHAPES[k]]


def box(a, b, c, d):
    return [[np.array([(a, b), (c, b), (c, d), (a, d), (a, b)], float)]]


CUTS = [
    (0, (100, -50, 400, 200), [[[(100, 0), (300, 0), (300, 200), (100, 200)]]]),
    (1, (60, 60, 400, 400), [[[(60, 60), (300, 60), (300, 120), (120, 120), (120, 300), (60, 300)]]]),
    (1, (90, 90, 400, 130), [[[(90, 90), (300, 90), (300, 120), (120, 120), (120, 130), (90, 130)]]]),
    (1, (100, 120, 400, 400), [[[(100, 120), (120, 120), (120, 300), (100, 300)]]]),
    (2, (-10, -10, 310, 310), [[[(0, 0), (300, 0), (300, 300), (0, 300)], [(90, 90), (90, 210), (210, 210), (210, 90)]]]),
    (2, (50, 50, 250, 250), [[[(50, 50), (250, 50), (250, 250), (50, 250)], [(90, 90), (90, 210), (210, 210), (210, 90)]]]),
    (2, (100, 0, 200, 300), [[[(100, 0), (200, 0), (200, 90), (100, 90)]], [[(100, 210), (200, 210), (200, 300), (100, 300)]]]),
    (2, (150, 0, 300, 300), [[[(150, 0), (300, 0), (300, 300), (150, 300), (150, 210), (210, 210), (210, 90), (150, 90)]]]),
    (2, (90, 90, 210, 210), []),
    (3, (60, 100, 240, 200), [[[(60, 100), (120, 100), (120, 200), (60, 200)]], [[(180, 100), (240, 100), (240, 200), (180, 200)]]]),
    (3, (120, 0, 180, 300), []),
    (4, (150, 150, 400, 400), [[[(150, 150), (360, 150), (150, 360)]]]),
    (4, (0, 0, 300, 300), [[[(0, 90), (90, 0), (210, 0), (300, 90), (300, 210), (210, 300), (90, 300), (0, 210)]]]),
]


@pytest.mark.parametrize("k,cut,want", CUTS)
def test_soil_shapes_cut_to_a_box(k, cut, want):
    got = G.overlap(shape_of(k), box(*cut))
    assert rings(got) == rings([[np.array(r + r[:1], float) for r in poly] for poly in want])
    assert not got or not G.crosses_itself(got)


W = 10.0
DRAWINGS = {
    "bow-tie": ([[[(0, 0), (10, 10), (10, 0), (0, 10), (0, 0)]]], 50, 2),
    "spike": ([[[(0, 0), (10, 0), (10, 10), (5, 10), (5, 14), (5, 10), (0, 10), (0, 0)]]], 100, 1),
    "hole outside": ([[[*BOX], [(90, 20), (100, 20), (100, 30), (90, 30), (90, 20)]]], 6500, 2),
    "touches itself": ([[[(0, 0), (5, 5), (10, 0), (10, 10), (5, 5), (0, 10), (0, 0)]]], 50, 2),
    "parts overlap": ([[[*BOX]], [[(x + 40, y + 40) for x, y in BOX]]], 2 * 6400 - 2 * 1600, 2),
    "hole crosses": ([[[*BOX], [(40, 40), (120, 40), (120, 60), (40, 60), (40, 40)]]], 6400 - 800 + 800, 2),
    "holes overlap": ([[[*BOX], [(10, 10), (50, 10), (50, 50), (10, 50), (10, 10)], [(30, 30), (70, 30), (70, 70), (30, 70), (30, 30)]]], 6400 - 3200 + 800, 2),
    "parts share a side": ([[[*BOX]], [[(x + 80, y) for x, y in BOX]]], 12_800, 1),
    "hole along the outline": ([[[*BOX], [(0, 20), (30, 20), (30, 40), (0, 40), (0, 20)]]], 5800, 1),
    "drawn twice": ([[[*BOX, *BOX[1:]]]], 0, 0),
    "hole that meets at a corner": ([[[*BOX], [(0, 0), (40, 20), (20, 40), (0, 0)]]], 6400 - 600, 1),
}


@pytest.mark.parametrize("name", DRAWINGS)
def test_bad_drawings_become_valid(name):
    drawn, m2, parts = DRAWINGS[name]
    got = G.repair([[np.array(r, float) for r in poly] for poly in drawn])
    assert area(got) == pytest.approx(m2) and len(got) == parts
    assert not got or not G.crosses_itself(got)


@pytest.mark.parametrize("seed", range(8))
def test_random_outlines_are_valid(seed):
    rng = np.random.default_rng(seed)
    for _ in range(25):
        p = rng.integers(0, 8, (int(rng.integers(4, 9)), 2)).astype(float) if seed % 2 else rng.normal(size=(int(rng.integers(4, 12)), 2)) * 100
        drawn = [[np.vstack([p, p[:1]])]]
        got = G.repair(drawn)
        want = G._area(G.trapezoids(drawn, drawn)) if G.crosses_itself(drawn) else area(drawn)
        assert not got or not G.crosses_itself(got)
        assert area(got) == pytest.approx(want, abs=1e-6)
        a, b = ([[star(rng, int(rng.integers(3, 14)), *rng.integers(-100, 100, 2), rng.integers(30, 300), bool(seed % 2))]] for _ in range(2))
        if not G.crosses_itself(a) and not G.crosses_itself(b):
            for x, y in ((a, b), (HOLED, b)):
                cut = G.overlap(x, y)
                assert area(cut) == pytest.approx(G.overlap_area(x, y), rel=1e-7, abs=1e-6) and (not cut or not G.crosses_itself(cut))


def test_validity_of_many_rows_is_that_of_each():
    rng = np.random.default_rng(0)
    shapes = [None, [], HOLED, [[np.array(BOX, float)], [np.array(BOX, float) + 40]], [[]], [[star(rng, 100, 0, 0, 500, True)]]]
    for _ in range(200):
        p = rng.integers(0, 8, (int(rng.integers(4, 12)), 2)).astype(float)
        shapes.append([[np.vstack([p, p[:1]])]])
    got = G.invalid_rows(G.Shapes(G.pack(shapes)))
    assert got.tolist() == [s is not None and G.crosses_itself(s) for s in shapes]
