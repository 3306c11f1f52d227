"""The NumPy helpers against hand-computed shapes and each other."""

import math
import random
import struct

import numpy as np
import pyarrow as pa
import pytest

from loamgrid.functions import geometry as G
from loamgrid.functions import links

SQUARE = [[np.array([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], float)]]
HOLED = [[SQUARE[0][0], np.array([(3, 3), (7, 3), (7, 7), (3, 7), (3, 3)], float)]]
BOW = [[np.array([(0, 0), (10, 10), (10, 0), (0, 10), (0, 0)], float)]]


def star(seed: int, n: int = 12):
    r = random.Random(seed)
    at = [(2 * math.pi * i / n, r.uniform(3, 10)) for i in range(n)]
    dx, dy = r.uniform(-3, 3), r.uniform(-3, 3)
    ring = [(dx + d * math.cos(a), dy + d * math.sin(a)) for a, d in at]
    return [[np.array([*ring, ring[0]])]]


def shoelace(shape) -> float:
    total = 0.0
    for poly in shape:
        for i, r in enumerate(poly):
            a = abs((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum()) / 2
            total += a if i == 0 else -a
    return total


def area(a, b) -> float:
    cut = G._area(G.trapezoids(a, b))
    assert G.overlap_area(a, b) == pytest.approx(cut)
    return cut


@pytest.mark.parametrize("order", "<>")
def test_wkb_both_orders_and_srid(order):
    ring = SQUARE[0][0]
    flag = b"\x01" if order == "<" else b"\x00"
    body = struct.pack(order + "II", 1, 5) + ring.astype(order + "f8").tobytes()
    plain = flag + struct.pack(order + "I", 3) + body
    tagged = flag + struct.pack(order + "II", 3 | 0x20000000, 4326) + body
    for data in (plain, tagged, G.write_wkb(SQUARE)):
        assert np.array_equal(G.read_wkb(data)[0][0], ring)
    assert G.read_wkb(b"\x01\x01") is None and G.read_wkb(None) is None


def test_wkb_drops_z():
    ring = np.hstack([SQUARE[0][0], np.full((5, 1), 7.0)])
    data = b"\x01" + struct.pack("<III", 3 | 0x80000000, 1, 5) + ring.tobytes()
    assert np.array_equal(G.read_wkb(data)[0][0], SQUARE[0][0])


def test_areas_of_overlaps():
    moved = [[SQUARE[0][0] + 5]]
    assert area(SQUARE, moved) == pytest.approx(25)
    assert area(HOLED, SQUARE) == pytest.approx(84)
    assert area(SQUARE, [[SQUARE[0][0] + 10]]) == 0
    assert area(BOW, BOW) == pytest.approx(50)
    assert shoelace(G.overlap(HOLED, moved)) == pytest.approx(25 - 4)


@pytest.mark.parametrize("seed", range(25))
def test_star_polygons(seed):
    a, b = star(seed), star(seed + 1000)
    assert area(a, a) == pytest.approx(shoelace(a))
    assert area(a, b) == pytest.approx(area(b, a))
    assert area(a, b) <= min(shoelace(a), shoelace(b)) + 1e-9
    assert shoelace(G.overlap(a, b)) == pytest.approx(area(a, b), abs=1e-6)


def test_touching_counts_as_meeting():
    assert G.intersects(SQUARE, [[SQUARE[0][0] + (10, 0)]])
    assert not G.intersects(SQUARE, [[SQUARE[0][0] + (10.5, 0)]])
    inner = [[SQUARE[0][0] / 10 + 4.5]]
    assert G.intersects(SQUARE, inner) and G.intersects(inner, SQUARE)
    assert not G.intersects(HOLED, inner)  # wholly in the hole
    apart = [[SQUARE[0][0] + 100], [SQUARE[0][0] / 10 + 4.5]]
    assert G.intersects(SQUARE, apart)


def test_self_crossing_and_simplify():
    assert G.crosses_itself(BOW) and not G.crosses_itself(HOLED)
    n = 200
    t = np.linspace(0, 2 * np.pi, n)
    ring = np.stack([1000 * np.cos(t), 1000 * np.sin(t)], 1)
    ring[-1] = ring[0]
    simple = G.simplify_ring(ring, 5)
    assert 4 <= len(simple) < n / 3 and np.array_equal(simple[0], simple[-1])
    assert shoelace([[simple]]) == pytest.approx(shoelace([[ring]]), rel=0.01)
    assert G.simplify_ring(SQUARE[0][0], 100) is SQUARE[0][0]


def decode_ring(text):
    shape = links.decoded(pa.array([text], pa.string())).to_pylist()[0]
    return shape and [(p["x"], p["y"]) for p in shape[0][0]]


def encode_ring(ring):
    return links.encoded(G.pack([ring and [[np.array(ring)]]])).to_pylist()[0]


@pytest.mark.parametrize(
    "text,first,acres",
    [("smg9lCv6o_jHAggmCok4BAA__lC", (-119.5258, 36.65111), 2525.14), ("oi4wgCzt_u_GAgnE8vDAA_mE", (-117.16169, 33.8289), 9.8098), ("o2--uC7kykrHAwtlBkicAAvtlB", (-123.28251, 41.4017), 631.79)],
)
def test_links(text, first, acres):
    ring = decode_ring(text)
    assert ring[0] == first and ring[-1] == first
    assert encode_ring(ring) == text


def test_bad_links():
    assert decode_ring("smg9lCv6o_jHAggmCok4BAA__l") is None
    assert decode_ring("!!") is None and decode_ring(None) is None and decode_ring("") is None


def plain_link(ring):
    """A link written number by number: twice a step, less one and turned over if it is below 0, in groups of five bits."""
    text, before = "", (0, 0)
    for lon, lat in ring[:-1]:
        here = (math.floor(lat * 1e6 + 0.5), math.floor(lon * 1e6 + 0.5))
        for v in (2 * (a - b) if a >= b else -2 * (a - b) - 1 for a, b in zip(here, before)):
            bits = [v >> k & 31 for k in range(0, max(1, v.bit_length()), 5)]
            text += "".join(links.ALPHABET[b + 32 * (k + 1 < len(bits))] for k, b in enumerate(bits))
        before = here
    return text


def test_links_of_a_batch():
    r = random.Random(8)
    rings = []
    for _ in range(300):
        n = r.randrange(3, 12)
        p = [(round(r.uniform(-180, 180), r.randrange(7)), round(r.uniform(-90, 90), r.randrange(7))) for _ in range(n)]
        rings.append([*p, p[0]])
    shapes = [None, [], [[]], [[np.zeros((0, 2))]], [[np.array(rings[0])], [np.array(rings[1])]], [[np.array(rings[2][:3])]], *([[np.array(x)]] for x in rings), None]
    got = links.encoded(G.pack(shapes)).to_pylist()
    assert got == [None] * 6 + [plain_link(x) for x in rings] + [None]
    back = links.decoded(pa.array(got).slice(3)).to_pylist()
    for ring, shape in zip(rings, back[3:-1]):
        assert [(p["x"], p["y"]) for p in shape[0][0]] == [(math.floor(x * 1e6 + 0.5) / 1e6, math.floor(y * 1e6 + 0.5) / 1e6) for x, y in ring]
    odd = ["", None, "A", "AAAAA", "AAAAAA", "AAAAAAA", "AAAAAg", "AAAAA!", "é", "_" * 40 + "A" * 6, "A" * 6 + "_" * 11 + "B", "__________P" + "AAAAA", "gggggggggggggggA" + "AAAAA"]
    ok = [x is not None for x in links.decoded(pa.array(odd, pa.string())).to_pylist()]
    assert ok == [False, False, False, False, True, False, False, False, False, False, False, False, True]
    assert links.decoded(pa.array([], pa.string())).to_pylist() == [] and links.encoded(G.pack([])).to_pylist() == []
