"""Geometry that built-in functions cannot express, as Arrow functions over batches.

Coordinates are taken from Arrow's flat buffers. Areas of overlaps are worked
out for all pairs of a batch at once; what needs a search (touching, validity,
clipped outlines) looks at one geometry or pair at a time, in blocks, so that
memory does not grow with the square of the edges. Spark does the partitioning,
the pairing and the shuffling.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .albers import to_4326
from .planar import region, regions
from .rings import RINGS

_VERTEX = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_KIND = pa.list_(pa.list_(pa.list_(_VERTEX)))
#: Pairs of edges looked at in one step.
_STEP = 1 << 20
#: Edges of a row up to which all its pairs are looked at together with those of other rows.
_SMALL = 64


def arrow_function(kind: str, once: bool = False):
    """An Arrow function of columns, made when it is called: its module can be imported without a session.

    ``once``: a filter on the result does not make Spark call it a second time.
    """

    def wrap(f):
        def call(*columns) -> Column:
            made = F.arrow_udf(f, kind)
            return (made.asNondeterministic() if once else made)(*columns)

        call.__doc__ = f.__doc__
        return call

    return wrap


# --- between Arrow and arrays -------------------------------------------------


class Shapes:
    """A column of geometries as flat arrays: vertices, and where rings, polygons and rows begin."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        starts = lambda c: np.append(0, np.cumsum(pc.fill_null(c.value_lengths(), 0).to_numpy(zero_copy_only=False)))
        polygons = column.flatten()
        rings = polygons.flatten()
        vertices = rings.flatten()
        self.valid = column.is_valid().to_numpy(zero_copy_only=False)
        self.rows, self.polygons, self.rings = starts(column), starts(polygons), starts(rings)
        self.xy = np.stack([vertices.field(k).to_numpy(zero_copy_only=False) for k in ("x", "y")], 1) if len(vertices) else np.zeros((0, 2))

    def __len__(self) -> int:
        return len(self.valid)

    def shape(self, i: int) -> list[list[np.ndarray]]:
        rings, xy = self.rings, self.xy
        return [[xy[rings[r] : rings[r + 1]] for r in range(self.polygons[p], self.polygons[p + 1])] for p in range(self.rows[i], self.rows[i + 1])]

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All edges (n, 4) with the row of each, and +1 or -1: outlines turn one way, holes the other."""
        first = np.ones(len(self.xy), bool)
        first[self.rings[:-1][np.diff(self.rings) > 0]] = False  # no edge ends at a ring's first vertex
        at = np.flatnonzero(first)
        ring = np.searchsorted(self.rings, at, side="right") - 1
        polygon = np.searchsorted(self.polygons, ring, side="right") - 1
        row = np.searchsorted(self.rows, polygon, side="right") - 1
        e = np.hstack([self.xy[at - 1], self.xy[at]])
        base = self.xy[self.rings[ring]]
        cross = (e[:, 0] - base[:, 0]) * (e[:, 3] - base[:, 1]) - (e[:, 2] - base[:, 0]) * (e[:, 1] - base[:, 1])
        turn = np.sign(np.bincount(ring, cross, len(self.rings) - 1))
        hole = np.ones(len(self.rings) - 1)
        hole[self.polygons[:-1][np.diff(self.polygons) > 0]] = -1  # an outline that turns left has its inside above its lower edges
        return e, row, (turn * hole)[ring]


def unpack(column: pa.Array) -> list[list[list[np.ndarray]] | None]:
    """Geometries as polygons of rings of (n, 2) arrays; null stays None."""
    shapes = Shapes(column)
    return [shapes.shape(i) if ok else None for i, ok in enumerate(shapes.valid)]


def pack(shapes: list) -> pa.Array:
    ends = lambda parts: np.append(0, np.cumsum([len(x) for x in parts])).astype(np.int32)
    polygons = [poly for s in shapes if s is not None for poly in s]
    rings = [np.asarray(r, float).reshape(-1, 2) for poly in polygons for r in poly]
    xy = np.concatenate([np.zeros((0, 2)), *rings])
    vertices = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], fields=list(_VERTEX))
    inner = pa.ListArray.from_arrays(ends(polygons), pa.ListArray.from_arrays(ends(rings), vertices))
    offsets = pa.array(ends([s or () for s in shapes]), pa.int32(), mask=np.append([s is None for s in shapes], False) if shapes else None)
    return pa.ListArray.from_arrays(offsets, inner).cast(_KIND)


def edges_of(shape) -> np.ndarray:
    """(n, 4) array of x1, y1, x2, y2."""
    parts = [np.hstack([r[:-1], r[1:]]) for poly in shape for r in poly if len(r) > 1]
    return np.concatenate(parts) if parts else np.zeros((0, 4))


# --- well-known binary --------------------------------------------------------


def read_wkb(data: bytes | None):
    """Polygon or MultiPolygon in either byte order, with or without SRID; further ordinates are dropped. Others: None."""
    if not data:
        return None
    at = 0

    def take(fmt: str):
        nonlocal at
        values = struct.unpack_from(fmt, data, at)
        at += struct.calcsize(fmt)
        return values

    def shape():
        nonlocal at
        order = "<" if take("B")[0] == 1 else ">"
        code = take(order + "I")[0]
        if code & 0x20000000:
            take(order + "I")
        dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        base = code & 0x0FFFFFFF
        dims += (0, 1, 1, 2)[base // 1000] if base < 4000 else 0
        base %= 1000
        if base == 3:
            rings = []
            for _ in range(take(order + "I")[0]):
                n = take(order + "I")[0]
                rings.append(np.frombuffer(data, order + "f8", n * dims, at).reshape(n, dims)[:, :2].astype(float))
                at += 8 * n * dims
            return [rings] if rings else []
        if base == 6:
            return [poly for _ in range(take(order + "I")[0]) for poly in shape()]
        raise ValueError("neither Polygon nor MultiPolygon")

    try:
        return shape()
    except (ValueError, struct.error):
        return None


def read_srid(data: bytes | None) -> int | None:
    """The SRID that extended WKB carries, if it does."""
    if not data or len(data) < 9:
        return None
    order = "<" if data[0] == 1 else ">"
    code, srid = struct.unpack_from(order + "II", data, 1)
    return srid if code & 0x20000000 else None


def write_wkb(shape, srid: int | None = None) -> bytes | None:
    """MultiPolygon, little-endian; extended by the SRID where one is given."""
    if shape is None:
        return None
    out = [struct.pack("<BII", 1, 6, len(shape)) if srid is None else struct.pack("<BIII", 1, 6 | 0x20000000, srid, len(shape))]
    for poly in shape:
        out.append(struct.pack("<BII", 1, 3, len(poly)))
        for ring in poly:
            out += [struct.pack("<I", len(ring)), np.asarray(ring, "<f8").tobytes()]
    return b"".join(out)


@arrow_function(RINGS)
def wkb_to_rings(column: pa.Array) -> pa.Array:
    return pack([read_wkb(x.as_py()) for x in column])


@arrow_function("int")
def wkb_srid(column: pa.Array) -> pa.Array:
    return pa.array([read_srid(x.as_py()) for x in column], pa.int32())


def rings_to_wkb(rings, srid: int | None = None) -> Column:
    """WKB of rings, assigned an SRID where one is given."""

    @arrow_function("binary")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([write_wkb(s, srid) for s in unpack(column)], pa.binary())

    return run(rings)


# --- predicates and overlay ---------------------------------------------------


def _side(e: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Sign of the turn from each edge to the point in the same row."""
    return np.sign((e[..., 2] - e[..., 0]) * (p[..., 1] - e[..., 1]) - (p[..., 0] - e[..., 0]) * (e[..., 3] - e[..., 1]))


def inside(edges: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Even-odd containment of points that are not on an edge."""
    out = np.zeros(len(points), bool)
    step = max(1, _STEP // max(1, len(edges)))
    for at in range(0, len(points), step):
        e, p = edges[:, None, :], points[None, at : at + step, :]
        up = (e[..., 1] > p[..., 1]) != (e[..., 3] > p[..., 1])
        left = (_side(e, p) > 0) == (e[..., 3] > e[..., 1])
        out[at : at + step] = (up & left).sum(0) % 2 == 1
    return out


def _boxes(e: np.ndarray) -> np.ndarray:
    """(n, 4) array of minx, miny, maxx, maxy of edges."""
    return np.hstack([np.minimum(e[:, :2], e[:, 2:]), np.maximum(e[:, :2], e[:, 2:])])


def _near(e: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Edges of e that meet the box of all of f."""
    b, box = _boxes(e), _boxes(f)
    low, high = box[:, :2].min(0), box[:, 2:].max(0)
    return e[(b[:, 0] <= high[0]) & (b[:, 2] >= low[0]) & (b[:, 1] <= high[1]) & (b[:, 3] >= low[1])]


def _meetings(e: np.ndarray, f: np.ndarray):
    """Index pairs (i, j) of edges of e and f whose boxes meet, in steps; e is sorted by its left ends."""
    b, c = _boxes(e), _boxes(f)
    order = np.argsort(b[:, 0], kind="stable")
    widest = (b[:, 2] - b[:, 0]).max(initial=0)
    left = b[order, 0]
    first, last = np.searchsorted(left, c[:, 0] - widest, side="left"), np.searchsorted(left, c[:, 2], side="right")
    total = np.append(0, np.cumsum(last - first))
    at = 0
    while at < len(f):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + _STEP, side="right")) - 1)
        n = (last - first)[at:stop]
        j = np.repeat(np.arange(at, stop), n)
        i = order[np.arange(len(j)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:stop], n)]
        on = (b[i, 0] <= c[j, 2]) & (b[i, 2] >= c[j, 0]) & (b[i, 1] <= c[j, 3]) & (b[i, 3] >= c[j, 1])
        yield i[on], j[on]
        at = stop


def _sides(e: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sides of f's ends as seen from e, and of e's as seen from f."""
    return _side(e, f[:, :2]), _side(e, f[:, 2:]), _side(f, e[:, :2]), _side(f, e[:, 2:])


def edges_meet(e: np.ndarray, f: np.ndarray) -> bool:
    """Whether an edge of e and one of f share a point."""
    if not len(e) or not len(f):
        return False
    p, q = _near(e, f), _near(f, e)
    if len(p) and len(q):
        for i, j in _meetings(p, q):
            s1, s2, t1, t2 = _sides(p[i], q[j])
            if ((s1 * s2 <= 0) & (t1 * t2 <= 0)).any():
                return True
    return False


def intersects(a, b) -> bool:
    """Whether two shapes share a point; touching counts."""
    e, f = edges_of(a), edges_of(b)
    if not len(e) or not len(f):
        return False
    if edges_meet(e, f):
        return True
    starts = lambda shape: np.array([poly[0][0] for poly in shape if poly and len(poly[0])]).reshape(-1, 2)
    return bool(inside(f, starts(a)).any() or inside(e, starts(b)).any())  # a part may lie wholly inside


def _meets_itself(shape) -> bool:
    """Whether edges cross, overlap, or a ring comes back to itself anywhere but at its ends."""
    rings = [r[np.append(True, (r[1:] != r[:-1]).any(1))] for poly in shape for r in poly if len(r)]
    rings = [r for r in rings if len(r) > 1]
    if not rings:
        return False
    e = np.concatenate([np.hstack([r[:-1], r[1:]]) for r in rings])
    size = np.array([len(r) - 1 for r in rings])
    ring = np.repeat(np.arange(len(rings)), size)
    nth = np.arange(len(e)) - np.repeat(np.cumsum(size) - size, size)
    for i, j in _meetings(e, e):
        i, j = i[i < j], j[i < j]
        if _meet_badly(e[i], e[j], ring[i] == ring[j], nth[i], nth[j], size[ring[i]]).any():
            return True
    return False


def _probes(ring: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Vertices and edge middles of a ring that lie on none of ``edges``."""
    p = np.concatenate([ring[:-1], (ring[:-1] + ring[1:]) / 2])
    on = np.zeros(len(p), bool)
    for i, j in _meetings(edges, np.hstack([p, p])):
        on[j[_side(edges[i], p[j]) == 0]] = True
    return p[~on]


def crosses_itself(shape) -> bool:
    """Whether a shape is not valid: edges that cross, overlap or touch where they should not, a hole outside its
    outline or inside another hole, polygons that share more than points."""
    if _meets_itself(shape):
        return True
    shape = [[r for r in poly if len(r) > 1] for poly in shape]
    shape = [poly for poly in shape if poly]
    sides = [[edges_of([[r]]) for r in poly] for poly in shape]
    for poly, own in zip(shape, sides):
        for k in range(1, len(poly)):
            probes = _probes(poly[k], own[0])
            if not len(probes) or not inside(own[0], probes).all():
                return True
            for m in range(1, len(poly)):
                if m != k and len(_near(own[k], own[m])):
                    probes = _probes(poly[k], own[m])
                    if len(probes) and inside(own[m], probes).any():
                        return True
    whole = [np.concatenate(own) for own in sides]
    for i, e in enumerate(whole):
        for j, f in enumerate(whole):
            if i != j and len(_near(e, f)):
                probes = _probes(shape[i][0], f)
                if len(probes) and inside(f, probes).any():
                    return True
    return False


def _crossing_heights(e: np.ndarray, f: np.ndarray) -> np.ndarray:
    """y of the crossings between edges of e and of f."""
    found = [np.zeros(0)]
    for i, j in _meetings(e, f):
        p, q = e[i], f[j]
        dx, dy, gx, gy = p[:, 2] - p[:, 0], p[:, 3] - p[:, 1], q[:, 2] - q[:, 0], q[:, 3] - q[:, 1]
        den = dx * gy - dy * gx
        p, q, dx, dy, gx, gy, den = (x[den != 0] for x in (p, q, dx, dy, gx, gy, den))
        t = ((q[:, 0] - p[:, 0]) * gy - (q[:, 1] - p[:, 1]) * gx) / den
        u = ((q[:, 0] - p[:, 0]) * dy - (q[:, 1] - p[:, 1]) * dx) / den
        found.append((p[:, 1] + t * dy)[(t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)])
    return np.concatenate(found)


def _slabs(edges: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where edges cut the slabs between ``ys``: slab, x at its bottom and x at its top, left to right in each slab."""
    low, high = np.minimum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 1], edges[:, 3])
    first, last = np.searchsorted(ys, low, side="left"), np.searchsorted(ys, high, side="right") - 1
    n = np.maximum(0, last - first)
    which = np.repeat(np.arange(len(edges)), n)
    slab = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    e = edges[which]
    rate = (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
    b, t = e[:, 0] + (ys[slab] - e[:, 1]) * rate, e[:, 0] + (ys[slab + 1] - e[:, 1]) * rate
    order = np.lexsort((b + t, slab))
    return slab[order], b[order], t[order]


def trapezoids(a, b) -> np.ndarray:
    """(n, 6) rows y0, y1, left and right at y0, left and right at y1: the common interior of two shapes, by parity."""
    e, f = edges_of(a), edges_of(b)
    if not len(e) or not len(f):
        return np.zeros((0, 6))
    crossed = [_crossing_heights(_near(e, f), _near(f, e))] if len(_near(e, f)) and len(_near(f, e)) else []
    crossed += [_crossing_heights(x, x) for x, shape in ((e, a), (f, b)) if _meets_itself(shape)]
    ys = np.unique(np.concatenate([e[:, 1], e[:, 3], f[:, 1], f[:, 3], *crossed]))
    floor, top = max(e[:, [1, 3]].min(), f[:, [1, 3]].min()), min(e[:, [1, 3]].max(), f[:, [1, 3]].max())
    ys = ys[(ys >= floor) & (ys <= top)]
    if len(ys) < 2:
        return np.zeros((0, 6))
    (sa, ba, ta), (sb, bb, tb) = _slabs(e, ys), _slabs(f, ys)
    at_a, at_b = np.searchsorted(sa, np.arange(len(ys))), np.searchsorted(sb, np.arange(len(ys)))
    rows = []
    for k in np.flatnonzero((np.diff(at_a) > 0) & (np.diff(at_b) > 0) & (np.diff(ys) >= 1e-12)).tolist():
        for i in range(at_a[k], at_a[k + 1] - 1, 2):
            for j in range(at_b[k], at_b[k + 1] - 1, 2):
                left = (ba[i], ta[i]) if ba[i] + ta[i] >= bb[j] + tb[j] else (bb[j], tb[j])
                right = (ba[i + 1], ta[i + 1]) if ba[i + 1] + ta[i + 1] <= bb[j + 1] + tb[j + 1] else (bb[j + 1], tb[j + 1])
                if sum(right) > sum(left):
                    rows.append((ys[k], ys[k + 1], left[0], right[0], left[1], right[1]))
    return np.array(rows).reshape(-1, 6)


def _crossed_rows(e: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Whether edges of a row cross one another; e is sorted by row."""
    out = np.zeros(rows, bool)
    start = np.append(0, np.cumsum(np.bincount(row, minlength=rows)))
    size = np.diff(start)
    for r in np.flatnonzero(size > 64):
        own = e[start[r] : start[r + 1]]
        for i, j in _meetings(own, own):
            s1, s2, t1, t2 = _sides(own[i], own[j])
            out[r] |= bool(((s1 * s2 < 0) & (t1 * t2 < 0)).any())
    few = np.flatnonzero((size <= 64)[row])
    n = start[row[few] + 1] - few - 1  # each edge with all after it
    for at in range(0, len(few), _STEP // 64):
        part, k = few[at : at + _STEP // 64], n[at : at + _STEP // 64]
        i = np.repeat(part, k)
        j = np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k) + i + 1
        s1, s2 = _side(e[i], e[j, :2]), _side(e[i], e[j, 2:])
        on = np.flatnonzero(s1 * s2 < 0)
        i, j = i[on], j[on]
        out[row[i[_side(e[j], e[i, :2]) * _side(e[j], e[i, 2:]) < 0]]] = True
    return out


def strip_areas(e: np.ndarray, row_e: np.ndarray, sign_e: np.ndarray, f: np.ndarray, row_f: np.ndarray, sign_f: np.ndarray, n_rows: int) -> np.ndarray:
    """For each row the sum, over pairs of an edge of e and one of f in it, of the signed area of what lies below both.

    Edges are (x0, y0, x1, y1) with x0 < x1 and heights from 0 up; both lists are in order of rows.
    """
    out = np.zeros(n_rows)
    at_f = np.append(0, np.cumsum(np.bincount(row_f, minlength=n_rows)))
    size = np.diff(at_f)[row_e]  # each edge of a meets all of b's in its row
    total = np.append(0, np.cumsum(size))
    at = 0
    while at < len(e):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + _STEP, side="right")) - 1)
        n = size[at:stop]
        i = np.repeat(np.arange(at, stop), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at_f[row_e[at:stop]], n)
        p, q = e[i], f[j]
        x0, x1 = np.maximum(p[:, 0], q[:, 0]), np.minimum(p[:, 2], q[:, 2])
        on = x1 > x0
        i, p, q, x0, x1, sign = i[on], p[on], q[on], x0[on], x1[on], (sign_e[i] * sign_f[j])[on]
        p_rate, q_rate = (p[:, 3] - p[:, 1]) / (p[:, 2] - p[:, 0]), (q[:, 3] - q[:, 1]) / (q[:, 2] - q[:, 0])
        p0, p1 = p[:, 1] + (x0 - p[:, 0]) * p_rate, p[:, 1] + (x1 - p[:, 0]) * p_rate
        q0, q1 = q[:, 1] + (x0 - q[:, 0]) * q_rate, q[:, 1] + (x1 - q[:, 0]) * q_rate
        d0, d1 = p0 - q0, p1 - q1
        mean = (np.minimum(p0, q0) + np.minimum(p1, q1)) / 2
        k = np.flatnonzero(d0 * d1 < 0)  # the lines cross on the way: two pieces
        t = d0[k] / (d0[k] - d1[k])
        peak = p0[k] + t * (p1[k] - p0[k])
        mean[k] = (t * (np.minimum(p0, q0)[k] + peak) + (1 - t) * (peak + np.minimum(p1, q1)[k])) / 2
        out += np.bincount(row_e[i], sign * mean * (x1 - x0), n_rows)
        at = stop
    return out


def overlap_areas(a: Shapes, b: Shapes) -> np.ndarray:
    """Area of the common interior of the shapes in the same row; 0 where one is null.

    Rows in which edges of a shape cross are cut by parity, one by one; else a shape is the sum of the strips below its edges, those of upper edges
    counted against those of lower ones. So the overlap is the sum, over pairs of
    edges, of what lies below both: the integral of the lower of two lines. All
    pairs of edges of a block of rows are worked out together.
    """
    (e, row_e, sign_e), (f, row_f, sign_f) = a.edges(), b.edges()
    crossed = _crossed_rows(e, row_e, len(a)) | _crossed_rows(f, row_f, len(a))
    base, top = (np.full((len(a), 2), v) for v in (-np.inf, np.inf))
    for x, row in ((e, row_e), (f, row_f)):
        low, high = np.full((len(a), 2), np.inf), np.full((len(a), 2), -np.inf)
        box = _boxes(x)
        np.minimum.at(low, row, box[:, :2])
        np.maximum.at(high, row, box[:, 2:])
        base, top = np.maximum(base, low), np.minimum(top, high)

    def kept(x, row, sign):
        # only edges above or below the common box count; heights are taken from its floor, for the digits' sake
        box = _boxes(x)
        on = (box[:, 0] < box[:, 2]) & (box[:, 2] > base[row, 0]) & (box[:, 0] < top[row, 0]) & (base[row] < top[row]).all(1)
        x, row, sign = x[on], row[on], sign[on]
        sign = np.where(x[:, 0] < x[:, 2], sign, -sign)
        x = np.where((x[:, 0] < x[:, 2])[:, None], x, x[:, [2, 3, 0, 1]]) - np.tile(base[row], 2)
        return x, row, sign

    (e, row_e, sign_e), (f, row_f, sign_f) = kept(e, row_e, sign_e), kept(f, row_f, sign_f)
    out = strip_areas(e, row_e, sign_e, f, row_f, sign_f, len(a))
    for i in np.flatnonzero(crossed & a.valid & b.valid).tolist():
        out[i] = _area(trapezoids(a.shape(i), b.shape(i)))
    return np.where(a.valid & b.valid, np.maximum(out, 0), 0)


def overlap_area(a, b) -> float:
    """Area of the common interior of two shapes."""
    return float(overlap_areas(Shapes(pack([a])), Shapes(pack([b])))[0])


def overlap(a, b) -> list:
    """The common interior as outlines with holes; a shape wholly inside the other is kept as it is."""
    e, f = edges_of(a), edges_of(b)
    if not len(e) or not len(f):
        return []
    near = [_near(e, f), _near(f, e)]
    for shape, x, y in ((a, e, f), (b, f, e)):
        if not len(_near(y, x)):
            return shape if inside(y, x[:1, :2])[0] else []
    if not len(near[0]) or not len(near[1]):
        return []
    return region(np.concatenate([e, f]), np.repeat([0, 1], [len(e), len(f)]), lambda side: side.all(1), _meetings, inside)


def _area(t: np.ndarray) -> float:
    return float(((t[:, 3] - t[:, 2] + t[:, 5] - t[:, 4]) / 2 * (t[:, 1] - t[:, 0])).sum())


def _inside_rows(e: np.ndarray, row: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Even-odd containment of one point for each row in the row's edges."""
    p = points[row]
    up = (e[:, 1] > p[:, 1]) != (e[:, 3] > p[:, 1])
    left = (_side(e, p) > 0) == (e[:, 3] > e[:, 1])
    return np.bincount(row[up & left], minlength=len(points)) % 2 == 1


def overlaps(a: pa.Array, b: pa.Array) -> pa.Array:
    """``overlap`` for every row: what is wholly inside or apart is told for all rows at once, rows of few edges are cut together, others alone."""
    a, b = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (a, b))
    x, y = Shapes(a), Shapes(b)
    n = len(x)
    (e, row_e, _), (f, row_f, _) = x.edges(), y.edges()
    n_e, n_f = np.bincount(row_e, minlength=n), np.bincount(row_f, minlength=n)
    both = x.valid & y.valid & (n_e > 0) & (n_f > 0)
    take = np.where(x.valid & y.valid, 2 * n, 2 * n + 1)  # rows of a, rows of b, none, null, and then what is cut
    open_ = both.copy()

    def boxes(edges, row):
        low, high, box = np.full((n, 2), np.inf), np.full((n, 2), -np.inf), _boxes(edges)
        np.minimum.at(low, row, box[:, :2])
        np.maximum.at(high, row, box[:, 2:])
        return low, high, box

    (low_e, high_e, box_e), (low_f, high_f, box_f) = boxes(e, row_e), boxes(f, row_f)

    def near(box, row, low, high):
        on = (box[:, :2] <= high[row]).all(1) & (box[:, 2:] >= low[row]).all(1)
        return np.bincount(row[on], minlength=n) > 0

    for at, edges, own_row, other, row, free in ((0, e, row_e, f, row_f, ~near(box_f, row_f, low_e, high_e)), (n, f, row_f, e, row_e, ~near(box_e, row_e, low_f, high_f))):
        free &= open_
        if free.any():
            points = np.zeros((n, 2))
            first = np.searchsorted(own_row, np.flatnonzero(free))
            points[free] = edges[first, :2]
            on = free[row]
            take[free & _inside_rows(other[on], row[on], points)] = -1 - at
            take = np.where(take < 0, -1 - take + np.arange(n), take)
            open_ &= ~free
    cut = np.flatnonzero(open_)
    few = n_e + n_f <= 2 * _SMALL
    shapes: dict[int, list] = {i: overlap(x.shape(i), y.shape(i)) for i in cut[~few[cut]].tolist()}
    small = cut[few[cut]]
    number = np.full(n, -1)
    number[small] = np.arange(len(small))
    parts, rows, source = [], [], []
    for k, (edges, row) in enumerate(((e, row_e), (f, row_f))):
        on = number[row] >= 0
        parts.append(edges[on])
        rows.append(number[row[on]])
        source.append(np.full(int(on.sum()), k))
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    made = regions(np.concatenate(parts)[order], np.concatenate(source)[order], row[order], len(small), lambda side: side.all(1), _meetings, inside)
    shapes.update(zip(small.tolist(), made))
    take[cut] = 2 * n + 2 + np.arange(len(cut))
    return pa.concat_arrays([a.cast(_KIND), b.cast(_KIND), pack([[], None, *(shapes[i] for i in cut.tolist())])]).take(pa.array(take))


#: Vertices of both sides that are clipped together.
_CLIPPED = 1 << 17


@arrow_function(RINGS)
def intersection(a: pa.Array, b: pa.Array) -> pa.Array:
    """The common interior."""
    ends = sum(s.rings[s.polygons[s.rows[1:]]] for s in (Shapes(a), Shapes(b)))
    out, at = [], 0
    while at < len(a):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _CLIPPED, side="right")))
        out.append(overlaps(a.slice(at, stop - at), b.slice(at, stop - at)))
        at = stop
    return pa.concat_arrays(out) if out else pack([])


@arrow_function(RINGS)
def in_degrees(a: pa.Array) -> pa.Array:
    """Every vertex from EPSG:5070 metres to degrees."""
    shapes = Shapes(a)
    lon, lat = to_4326(shapes.xy[:, 0], shapes.xy[:, 1], np)
    vertices = pa.StructArray.from_arrays([pa.array(lon), pa.array(lat)], fields=list(_VERTEX))
    ends = lambda x: pa.array(x.astype(np.int32))
    inner = pa.ListArray.from_arrays(ends(shapes.polygons), pa.ListArray.from_arrays(ends(shapes.rings), vertices))
    offsets = pa.array(shapes.rows.astype(np.int32), mask=np.append(~shapes.valid, False))
    return pa.ListArray.from_arrays(offsets, inner).cast(_KIND)


def _areas(a: pa.Array, b: pa.Array, apart_is_null: bool) -> pa.Array:
    x, y = Shapes(a), Shapes(b)
    m2 = overlap_areas(x, y)
    none = ~(x.valid & y.valid)
    if apart_is_null:
        # what overlaps by more than rounding meets; the few others are looked at edge by edge
        for i in np.flatnonzero(~none & (m2 < 1e-6)).tolist():
            none[i] = not intersects(x.shape(i), y.shape(i))
    return pa.array(m2, mask=none)


@arrow_function("double")
def intersection_area(a: pa.Array, b: pa.Array) -> pa.Array:
    """Area of the common interior."""
    return _areas(a, b, False)


@arrow_function("double", once=True)
def meeting_area(a: pa.Array, b: pa.Array) -> pa.Array:
    """Area of the common interior; null where they do not even touch."""
    return _areas(a, b, True)


@arrow_function("boolean")
def shapes_intersect(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether two shapes share a point; touching counts."""
    return pa.array([None if x is None or y is None else intersects(x, y) for x, y in zip(unpack(a), unpack(b))], pa.bool_())


def invalid_rows(shapes: Shapes) -> np.ndarray:
    """``crosses_itself`` for every row: rows of few edges are looked at together, and only what passes and has holes or parts alone."""
    out, at = np.zeros(len(shapes), bool), np.arange(1, len(shapes.xy))
    n_rings = np.diff(shapes.polygons[shapes.rows])
    ends = shapes.rings[1:-1]
    at = at[~np.isin(at, ends[ends < len(shapes.xy)])]  # no edge ends at a ring's first vertex
    e = np.hstack([shapes.xy[at - 1], shapes.xy[at]]) if len(at) else np.zeros((0, 4))
    there = (e[:, :2] != e[:, 2:]).any(1)
    e, at = e[there], at[there]
    ring = np.searchsorted(shapes.rings, at, side="right") - 1
    row = np.searchsorted(shapes.rows, np.searchsorted(shapes.polygons, ring, side="right") - 1, side="right") - 1
    size = np.bincount(ring, minlength=len(shapes.rings))
    nth = np.arange(len(e)) - (np.cumsum(size) - size)[ring]
    edges = np.bincount(row, minlength=len(shapes))
    few = np.flatnonzero((edges <= _SMALL)[row])
    after = (np.cumsum(edges)[row] - np.arange(len(e)) - 1)[few]
    box = _boxes(e)
    for k in range(0, len(few), _STEP // _SMALL):
        part, count = few[k : k + _STEP // _SMALL], after[k : k + _STEP // _SMALL]
        i = np.repeat(part, count)
        j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + i + 1
        near = np.flatnonzero((box[i, :2] <= box[j, 2:]).all(1) & (box[j, :2] <= box[i, 2:]).all(1))
        i, j = i[near], j[near]
        out[row[i[_meet_badly(e[i], e[j], ring[i] == ring[j], nth[i], nth[j], size[ring[i]])]]] = True
    for r in np.flatnonzero(~out & ((edges > _SMALL) | (n_rings > 1))).tolist():
        out[r] = crosses_itself(shapes.shape(r))
    return out


def _meet_badly(e: np.ndarray, f: np.ndarray, same: np.ndarray, nth_e: np.ndarray, nth_f: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether two edges cross, lie on one another, or touch though they are no neighbours in a ring (``same``) of ``size`` edges."""
    s1, s2, t1, t2 = _sides(e, f)
    crossed = (s1 * s2 < 0) & (t1 * t2 < 0)
    flat = (s1 == 0) & (s2 == 0) & (t1 == 0) & (t2 == 0)
    b, c = _boxes(e), _boxes(f)
    along = flat & ((np.minimum(b[:, 2:], c[:, 2:]) - np.maximum(b[:, :2], c[:, :2])).max(1, initial=0) > 0)
    gap = np.abs(nth_e - nth_f)
    return crossed | along | ((s1 * s2 <= 0) & (t1 * t2 <= 0) & same & (gap != 1) & (gap != size - 1))


@arrow_function("boolean", once=True)
def self_crossing(a: pa.Array) -> pa.Array:
    shapes = Shapes(a)
    return pa.array(invalid_rows(shapes), pa.bool_(), mask=~shapes.valid)


def repair(shape) -> list:
    """A shape drawn anew by even-odd parity: outlines with their holes, that touch at points only."""
    e = edges_of(shape)
    return region(e, np.zeros(len(e), int), lambda side: side[:, 0], _meetings, inside)


@arrow_function(RINGS)
def repaired(a: pa.Array) -> pa.Array:
    """A self-crossing shape cut anew by even-odd parity; others unchanged."""
    shapes = Shapes(a)
    wrong = invalid_rows(shapes)
    if not wrong.any():
        return a
    return pack([None if not ok else repair(shapes.shape(i)) if wrong[i] else shapes.shape(i) for i, ok in enumerate(shapes.valid)])


def clean_shapes(column: pa.Array) -> pa.Array:
    """Shapes as they are, but for those whose edges cross: these cut anew by parity."""
    shapes = Shapes(column)
    e, row, _ = shapes.edges()
    crossed = _crossed_rows(e, row, len(shapes))
    if not crossed.any():
        return column
    return pack([None if not ok else repair(shapes.shape(i)) if crossed[i] else shapes.shape(i) for i, ok in enumerate(shapes.valid)])


def _keep_line(p: np.ndarray, tolerance: float) -> np.ndarray:
    keep = np.zeros(len(p), bool)
    keep[[0, -1]] = True
    stack = [(0, len(p) - 1)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        d, v = p[j] - p[i], p[i + 1 : j] - p[i]
        norm = np.hypot(*d)
        away = np.abs(d[0] * v[:, 1] - d[1] * v[:, 0]) / norm if norm else np.hypot(v[:, 0], v[:, 1])
        k = int(away.argmax())
        if away[k] > tolerance:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return keep


def simplify_ring(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on a closed ring; one that would collapse or cross itself is left as it is."""
    if tolerance <= 0 or len(ring) <= 4:
        return ring
    far = int(np.hypot(*(ring - ring[0]).T).argmax())
    if far == 0:
        return ring
    keep = np.concatenate([_keep_line(ring[: far + 1], tolerance), _keep_line(ring[far:], tolerance)[1:]])
    out = ring[keep]
    return out if len(out) >= 4 and not crosses_itself([[out]]) else ring


def simplified(rings: Column, tolerance: float) -> Column:
    @arrow_function(RINGS)
    def run(a: pa.Array) -> pa.Array:
        return pack([None if s is None else [[simplify_ring(r, tolerance) for r in poly] for poly in s] for s in unpack(a)])

    return run(rings)
