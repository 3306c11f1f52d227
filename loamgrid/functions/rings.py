"""Polygons as nested arrays, and what built-in functions can tell about them.

A geometry is polygons -> rings -> vertices; the first ring of a polygon is its
outline, the others are holes, and a ring ends where it began.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .albers import to_4326, to_5070

RINGS = "array<array<array<struct<x:double,y:double>>>>"
M2_PER_ACRE = 4046.8564224
ACRES_PER_PIXEL = 900 / M2_PER_ACRE


def _vertices(rings: Column) -> Column:
    return F.flatten(F.flatten(rings))


def bbox(rings: Column) -> Column:
    """struct(minx, miny, maxx, maxy) of all rings."""
    v = _vertices(rings)
    xs, ys = F.transform(v, lambda p: p["x"]), F.transform(v, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def with_bbox(df: DataFrame, geometry: str = "rings") -> DataFrame:
    """Adds minx, miny, maxx and maxy, computed once per row."""
    return df.withColumn("_box", bbox(F.col(geometry))).select("*", "_box.*").drop("_box")


def bbox_overlaps(a: tuple, b: tuple) -> Column:
    """Whether two boxes (minx, miny, maxx, maxy) meet; touching counts."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def map_vertices(rings: Column, f) -> Column:
    return F.transform(rings, lambda poly: F.transform(poly, lambda ring: F.transform(ring, f)))


def vertex(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def project(rings: Column, inverse: bool = False) -> Column:
    """Every vertex from degrees to EPSG:5070 metres, or back."""
    return map_vertices(rings, lambda p: vertex(*(to_4326 if inverse else to_5070)(p["x"], p["y"])))


def swap_axes(rings: Column) -> Column:
    return map_vertices(rings, lambda p: vertex(p["y"], p["x"]))


def normalise(rings: Column, places: int = 6) -> Column:
    """Every coordinate rounded half-even, so that near-identical drawings agree."""
    return map_vertices(rings, lambda p: vertex(F.bround(p["x"], places), F.bround(p["y"], places)))


def _ring_sum(ring: Column, f) -> Column:
    """Sum of f(x1, y1, x2, y2) over a ring's edges, with coordinates taken from its first vertex."""
    steps = F.sequence(F.lit(1), F.size(ring) - 1)
    ox, oy = ring[0]["x"], ring[0]["y"]
    total = F.aggregate(steps, F.lit(0.0), lambda t, i: t + f(ring[i - 1]["x"] - ox, ring[i - 1]["y"] - oy, ring[i]["x"] - ox, ring[i]["y"] - oy))
    return F.when(F.size(ring) >= 2, total).otherwise(F.lit(0.0))


def area_m2(rings: Column) -> Column:
    """Area by the shoelace formula; holes take away."""

    def polygon(poly: Column) -> Column:
        parts = F.transform(poly, lambda r, i: F.abs(_ring_sum(r, lambda a, b, c, d: a * d - c * b)) / 2 * F.when(i == 0, 1.0).otherwise(-1.0))
        return F.aggregate(parts, F.lit(0.0), lambda t, x: t + x)

    return F.aggregate(F.transform(rings, polygon), F.lit(0.0), lambda t, x: t + x)


def centroid(rings: Column) -> Column:
    """struct(x, y) of the area's centre of mass."""

    def moments(ring: Column, sign: Column) -> Column:
        a = _ring_sum(ring, lambda a, b, c, d: a * d - c * b)
        mx = _ring_sum(ring, lambda a, b, c, d: (a + c) * (a * d - c * b)) / 6
        my = _ring_sum(ring, lambda a, b, c, d: (b + d) * (a * d - c * b)) / 6
        turn = F.when(a < 0, -sign).otherwise(sign)
        return F.struct((a / 2 * turn).alias("a"), ((mx + a / 2 * ring[0]["x"]) * turn).alias("mx"), ((my + a / 2 * ring[0]["y"]) * turn).alias("my"))

    parts = F.flatten(F.transform(rings, lambda poly: F.transform(poly, lambda r, i: moments(r, F.when(i == 0, 1.0).otherwise(-1.0)))))
    total = lambda k: F.aggregate(F.transform(parts, lambda m: m[k]), F.lit(0.0), lambda t, x: t + x)
    a = F.nullif(total("a"), F.lit(0.0))
    return F.struct((total("mx") / a).alias("x"), (total("my") / a).alias("y"))


def ring_status(rings: Column) -> Column:
    """``bad_ring`` unless every ring has four positions or more and ends where it began; ``bad_geometry`` for null."""
    ok = F.forall(rings, lambda poly: (F.size(poly) > 0) & F.forall(poly, lambda r: (F.size(r) >= 4) & (F.get(r, F.lit(0)) == F.get(r, F.size(r) - 1))))
    return F.when(rings.isNull(), "bad_geometry").when((F.size(rings) > 0) & F.coalesce(ok, F.lit(False)), "ok").otherwise("bad_ring")


def edges(rings: Column) -> Column:
    """array of struct(x1, y1, x2, y2): every edge of every ring."""

    def of(ring: Column) -> Column:
        return F.transform(
            F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))),
            lambda p, i: F.struct(ring[i]["x"].alias("x1"), ring[i]["y"].alias("y1"), p["x"].alias("x2"), p["y"].alias("y2")),
        )

    return F.flatten(F.flatten(F.transform(rings, lambda poly: F.transform(poly, of))))


#: Stands for a point on an edge, whatever other edges say; even, so that it counts as outside.
_ON = -1_000_000


def contains(edge_list: Column, x: Column, y: Column) -> Column:
    """Whether (x, y) lies inside by even-odd parity; a point on an edge does not. Exact for whole coordinates."""

    def step(total: Column, e: Column) -> Column:
        # one look at each edge: one of other heights is passed over, one to the right counts, one that holds the point decides
        turn = (e["x2"] - e["x1"]) * (y - e["y1"]) - (x - e["x1"]) * (e["y2"] - e["y1"])
        apart = ((e["y1"] > y) & (e["y2"] > y)) | ((e["y1"] < y) & (e["y2"] < y))
        on = (turn == 0) & (x >= F.least(e["x1"], e["x2"])) & (x <= F.greatest(e["x1"], e["x2"]))
        right = ((e["y1"] > y) != (e["y2"] > y)) & ((turn > 0) == (e["y2"] > e["y1"]))
        return F.when(apart, total).when(on, F.lit(_ON)).when(right & (total >= 0), total + 1).otherwise(total)

    return F.aggregate(edge_list, F.lit(0), step) % 2 == 1


def square(lon: Column, lat: Column, half_m: Column) -> Column:
    """Rings of a square of half side ``half_m`` metres around a point in degrees, six decimals."""
    dlat = half_m / 111_320.0
    dlon = half_m / (111_320.0 * F.greatest(F.lit(0.1), F.abs(F.cos(F.radians(lat)))))
    at = lambda sx, sy: vertex(F.round(lon + sx * dlon, 6), F.round(lat + sy * dlat, 6))
    return F.array(F.array(F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1), at(-1, -1))))


def rectangle(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    return F.array(F.array(F.array(vertex(minx, miny), vertex(maxx, miny), vertex(maxx, maxy), vertex(minx, maxy), vertex(minx, miny))))
