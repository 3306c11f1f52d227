"""Field links: a ring as zig-zag delta text, six bits a character.

Both ways work on the flat buffers of a whole batch: every vertex is a pair of
numbers, every number up to seven characters of five bits and a mark that more
follow, and what belongs to which ring is kept beside them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .geometry import Shapes, arrow_function
from .rings import RINGS
from .tiles import spread

# The link alphabet and its coordinate precision.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
PRECISION = 1_000_000

_LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)
_DIGIT = np.full(256, 255, np.uint8)
_DIGIT[_LETTERS] = np.arange(64)
#: Characters of a number that fits a long; longer ones are off the world anyway.
_MOST = 12
_VERTEX = pa.struct([("x", pa.float64()), ("y", pa.float64())])


def _totals(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Running sums that begin anew in each of the stretches which end at ``ends``."""
    if not len(values):
        return values
    total = np.cumsum(values)
    starts = np.append(0, ends[:-1])
    before = np.where(starts > 0, total[np.maximum(starts - 1, 0)], 0)
    return total - np.repeat(before, ends - starts)


def encode(xy: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all rings (lon, lat) and how many each has; rings end at ``ends`` and do not repeat their first point."""
    whole = np.floor(xy[:, ::-1] * PRECISION + 0.5).astype(np.int64)  # lat, lon
    step = np.diff(whole, axis=0, prepend=np.zeros((1, 2), np.int64))
    first = np.append(0, ends[:-1])[np.diff(ends, prepend=0) > 0]
    step[first] = whole[first]
    value = np.where(step < 0, -2 * step - 1, 2 * step).reshape(-1)
    size = np.maximum(1, -(-np.ceil(np.log2(value + 1.0)).astype(np.int64) // 5))
    size += value >= (np.int64(1) << np.minimum(5 * size, 62))  # where the logarithm was rounded down
    which, nth = spread(size)
    digit = (value[which] >> (5 * nth)) & 31
    text = _LETTERS[digit + 32 * (nth + 1 < size[which])]
    per_ring = np.add.reduceat(np.append(size, 0), np.minimum(np.append(0, 2 * ends[:-1]), len(size))) if len(ends) else np.zeros(0, np.int64)
    return text, np.where(np.diff(ends, prepend=0) > 0, per_ring, 0)


def decode(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points (lon, lat) of all texts, how many each has, and which texts are links: known characters, whole numbers, pairs, three points, on the world."""
    digit = _DIGIT[text]
    n = np.diff(ends, prepend=0)
    row = np.repeat(np.arange(len(ends)), n)
    bad = np.bincount(row, digit == 255, len(ends)) > 0
    last = digit < 32
    bad |= (n > 0) & ~last[np.maximum(ends - 1, 0)] if len(text) else n < 0
    keep = ~bad[row]
    digit, last, row = digit[keep].astype(np.int64), last[keep], row[keep]
    stop = np.flatnonzero(last)
    which = np.cumsum(last) - last
    nth = np.arange(len(digit)) - np.append(0, stop + 1)[which]
    owner = row[stop]
    long = np.bincount(which, (nth >= _MOST) & (digit % 32 > 0), len(stop)) > 0
    value = np.zeros(len(stop), np.int64)
    np.add.at(value, which, np.where(nth < _MOST, digit % 32 << (5 * np.minimum(nth, _MOST - 1)), 0))
    step = np.where(value % 2 == 1, -(value + 1) // 2, value // 2)
    numbers = np.bincount(owner, minlength=len(ends))
    bad |= (numbers % 2 == 1) | (numbers < 6) | (np.bincount(owner, long, len(ends)) > 0)
    step = step[~bad[owner]].reshape(-1, 2)
    points = np.where(bad, 0, numbers // 2)
    at = np.cumsum(points)
    # beyond any step on the world a sum could leave a long: such rows go first
    own = np.repeat(np.arange(len(ends)), points)
    far = np.abs(step).max(1, initial=0) > 360 * PRECISION
    wild = np.bincount(own, far, len(ends)) > 0
    step[wild[own]] = 0
    whole = np.stack([_totals(step[:, k], at) for k in (0, 1)], 1) if len(step) else np.zeros((0, 2), np.int64)
    off = (np.abs(whole[:, 0]) > 90 * PRECISION) | (np.abs(whole[:, 1]) > 180 * PRECISION)
    good = ~bad & ~wild & ~(np.bincount(own, off, len(ends)) > 0)
    return whole[good[own]][:, ::-1] / PRECISION, np.where(good, points, 0), good


def decoded(links: pa.Array) -> pa.Array:
    """Closed rings of links; null for what is none."""
    data = pc.fill_null(links, "").cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int64)
    text = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(data) and data.buffers()[2] else np.zeros(0, np.uint8)
    xy, points, good = decode(text, offsets[1:] - offsets[0])
    # each ring gets its first point once more
    ends = np.cumsum(points)
    again = np.insert(np.arange(len(xy)), ends[good], (ends - points)[good])
    closed = np.where(good, points + 1, 0)
    vertices = pa.StructArray.from_arrays([pa.array(xy[again, k]) for k in (0, 1)], fields=list(_VERTEX))
    rings = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(closed[good])).astype(np.int32)), vertices)
    one = pa.array(np.arange(int(good.sum()) + 1, dtype=np.int32))
    offsets = pa.array(np.append(0, np.cumsum(good)).astype(np.int32), mask=np.append(~good, False))
    return pa.ListArray.from_arrays(offsets, pa.ListArray.from_arrays(one, rings))


def encoded(column: pa.Array) -> pa.Array:
    """Links of single polygons (outline only); null for several parts, and for fewer than four positions."""
    shapes = Shapes(column)
    parts = np.diff(shapes.rows)
    polygon = np.minimum(shapes.rows[:-1], max(0, len(shapes.polygons) - 2))
    first = np.minimum(shapes.polygons[polygon], max(0, len(shapes.rings) - 2)) if len(shapes.polygons) > 1 else np.zeros(len(shapes), np.int64)
    has = (parts == 1) & shapes.valid
    if len(shapes.polygons) > 1:
        has &= np.diff(shapes.polygons)[polygon] > 0
    start = shapes.rings[first] if len(shapes.rings) > 1 else np.zeros(len(shapes), np.int64)
    size = np.where(has, (np.diff(shapes.rings)[first] if len(shapes.rings) > 1 else 0), 0)
    has &= size >= 4
    size = np.where(has, size, 0)
    end = np.maximum(start + size - 1, 0)
    if len(shapes.xy):
        size -= has & (shapes.xy[np.minimum(start, len(shapes.xy) - 1)] == shapes.xy[np.minimum(end, len(shapes.xy) - 1)]).all(1)
    which, nth = spread(size)
    text, long = encode(shapes.xy[start[which] + nth], np.cumsum(size))
    offsets = pa.array(np.append(0, np.cumsum(long)).astype(np.int32))
    made = pa.Array.from_buffers(pa.string(), len(shapes), [None, offsets.buffers()[1], pa.py_buffer(text.tobytes())])
    return pc.if_else(pa.array(has), made, pa.scalar(None, pa.string()))


decode_links, encode_links = arrow_function(RINGS)(decoded), arrow_function("string")(encoded)
