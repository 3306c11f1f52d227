"""Simplification of a whole layer that keeps its topology.

Rings are cut at nodes, the vertices where more or fewer than two stretches of
border meet. What lies between two nodes is an arc; neighbours share it, and it is
simplified once, whichever of them it is taken from. A stretch is replaced by a
straight line only if it lies within the tolerance of it and no other vertex of
the layer lies between the two: then no border can come to cross another, and
nothing changes sides (a hole stays in its outline). Of several arcs between the
same two nodes, and of a ring without nodes, enough is kept that no polygon folds.

Neighbours are expected to have the same vertices along their common border.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import _near, inside
from ..sources.tables import stored

#: Side of the tiles in which arcs and vertices meet, in tolerances.
REACH = 32


def _between(chain: np.ndarray, others: np.ndarray) -> bool:
    """Whether a point lies between a chain and the line from its first to its last point, or on them."""
    e = np.vstack([np.hstack([chain[:-1], chain[1:]]), np.hstack([chain[-1], chain[0]])[None]])
    near = _near(np.hstack([others, others]), e)[:, :2] if len(others) else others
    near = near[~((near == chain[0]).all(1) | (near == chain[-1]).all(1))]
    if not len(near):
        return False
    d, p = e[None, :, 2:] - e[None, :, :2], near[:, None, :] - e[None, :, :2]
    on = (d[..., 0] * p[..., 1] == d[..., 1] * p[..., 0]) & ((p * (p - d)).sum(2) <= 0)
    return bool(on.any() or inside(e, near).any())


def simplify_arc(arc: np.ndarray, others: np.ndarray, tolerance: float, least: int = 2) -> np.ndarray:
    """Which points of an arc stay: its ends, ``least`` of them if it has so many, and what tolerance and ``others`` call for."""
    n = len(arc)
    keep = np.zeros(n, bool)
    keep[[0, -1]] = True
    stack = [(0, n - 1)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        d, v = arc[j] - arc[i], arc[i + 1 : j] - arc[i]
        length = np.hypot(*d)
        away = np.abs(d[0] * v[:, 1] - d[1] * v[:, 0]) / length if length else np.hypot(v[:, 0], v[:, 1])
        k = i + 1 + int(away.argmax())
        foreign = lambda: np.concatenate([others, arc[:i], arc[j + 1 :]])  # noqa: B023, E731
        if away[k - i - 1] > tolerance or n <= least or (i, j) == (0, n - 1) and least > 2 or _between(arc[i : j + 1], foreign()):
            keep[k] = True
            stack += [(i, k), (k, j)]
    if keep.sum() < least <= n:  # a closed arc: a third point, the farthest from the line between the two
        a, b = arc[np.flatnonzero(keep)[:2]]
        away = np.abs((b[0] - a[0]) * (arc[:, 1] - a[1]) - (b[1] - a[1]) * (arc[:, 0] - a[0]))
        keep[np.where(keep, -1, away).argmax()] = True
    return keep


def _rings(polygons: DataFrame, key: str) -> DataFrame:
    """(key, part, ring, pos, x, y, before, after): every vertex of every ring once, with its neighbours as points."""
    ring = lambda r: F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0)))
    rows = polygons.select(key, F.posexplode("rings").alias("part", "_poly")).select(key, "part", F.posexplode("_poly").alias("ring", "_r"))
    rows = rows.withColumn("_r", ring(F.array_compact(F.transform("_r", lambda p, i: F.when((i == 0) | (p != F.get("_r", i - 1)), p)))))
    rows = rows.select(key, "part", "ring", "_r", F.posexplode("_r").alias("pos", "_p"))
    at = lambda k: F.get("_r", F.pmod(F.col("pos") + k, F.size("_r")))
    return rows.select(key, "part", "ring", "pos", "_p.x", "_p.y", at(-1).alias("before"), at(1).alias("after"))


def _cut(batches, key: str):
    """Rings with flags to arcs in the direction that both neighbours take: (key, part, ring, nth, turned, closed, arc, xs, ys)."""
    for batch in batches:
        out = {n: [] for n in ("row", "nth", "turned", "closed", "arc", "xs", "ys")}
        for i, at in enumerate(batch.column("at")):
            values = at.values
            p = np.stack([values.field(k).to_numpy(zero_copy_only=False) for k in ("x", "y")], 1)
            nodes = np.flatnonzero(values.field("node").to_numpy(zero_copy_only=False))
            closed = not len(nodes)
            if closed:  # from the least vertex, towards the lesser of its neighbours
                nodes = np.lexsort((p[:, 1], p[:, 0]))[:1]
            p = np.roll(p, -nodes[0], 0)
            ends = np.append(nodes - nodes[0], len(p))
            p = np.vstack([p, p[:1]])
            for nth, (a, b) in enumerate(zip(ends, ends[1:])):
                chain = p[a : b + 1]
                turned = tuple(map(tuple, chain[::-1])) < tuple(map(tuple, chain))
                chain = chain[::-1] if turned else chain
                for name, value in zip(out, (i, nth, turned, closed or bool((chain[0] == chain[-1]).all()), hashlib.blake2b(chain.tobytes(), digest_size=16).hexdigest(), chain[:, 0], chain[:, 1])):
                    out[name].append(value)
        rows = pa.array(out["row"], pa.int64())
        own = [batch.column(k).take(rows) for k in (key, "part", "ring")]
        rest = [pa.array(out["nth"], pa.int32()), pa.array(out["turned"], pa.bool_()), pa.array(out["closed"], pa.bool_()), pa.array(out["arc"], pa.string()), pa.array(out["xs"], pa.list_(pa.float64())), pa.array(out["ys"], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays([*own, *rest], [key, "part", "ring", "nth", "turned", "closed", "arc", "xs", "ys"])


def simplify_layer(polygons: DataFrame, tolerance: float = 30.0, key: str = "polygon_id") -> DataFrame:
    """``polygons`` with simplified rings; the border that neighbours share stays one border. ``key`` is unique; rows without rings stay as they are."""
    if tolerance <= 0:
        return polygons
    kind = polygons.schema[key].dataType.simpleString()
    vertices = stored(_rings(polygons, key), "ring-vertices")
    ends = vertices.select("x", "y", F.explode(F.array("before", "after")).alias("to"))
    nodes = ends.groupBy("x", "y").agg(F.size(F.collect_set("to")).alias("ways")).filter("ways != 2").select("x", "y", F.lit(True).alias("node"))
    flagged = vertices.join(nodes, ["x", "y"], "left").withColumn("node", F.coalesce("node", F.lit(False)))
    rings = flagged.groupBy(key, "part", "ring").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y", "node"))).alias("at"))
    pieces = stored(rings.mapInArrow(lambda b: _cut(b, key), f"`{key}` {kind}, part int, ring int, nth int, turned boolean, closed boolean, arc string, xs array<double>, ys array<double>"), "arcs")

    arcs = pieces.select("arc", "closed", "xs", "ys").dropDuplicates(["arc"])
    two = F.array_sort(F.array(F.struct(F.col("xs")[0].alias("x"), F.col("ys")[0].alias("y")), F.struct(F.element_at("xs", -1).alias("x"), F.element_at("ys", -1).alias("y"))))
    twins = arcs.groupBy(two.alias("two")).agg(F.count("*").alias("n")).filter("n > 1").select("two", F.lit(True).alias("twin"))
    arcs = arcs.withColumn("two", two).join(twins, "two", "left").drop("two")
    side = float(tolerance) * REACH
    at = lambda v: F.floor(v / side).cast("long")
    tile = lambda x, y: F.struct(x.alias("ix"), y.alias("iy"))
    step = F.sequence(F.lit(1), F.size("xs") - 1)
    box = lambda c, i: (F.least(F.get(c, i - 1), F.get(c, i)), F.greatest(F.get(c, i - 1), F.get(c, i)))
    cells = lambda i: F.flatten(F.transform(F.sequence(at(box("xs", i)[0] - tolerance), at(box("xs", i)[1] + tolerance)), lambda cx: F.transform(F.sequence(at(box("ys", i)[0] - tolerance), at(box("ys", i)[1] + tolerance)), lambda cy: tile(cx, cy))))
    reach = arcs.filter(F.size("xs") > 2).select("arc", F.explode(F.array_distinct(F.flatten(F.transform(step, cells)))).alias("tile"))
    there = vertices.select("x", "y").distinct().select("x", "y", tile(at(F.col("x")), at(F.col("y"))).alias("tile"))
    near = reach.join(there, "tile").groupBy("arc").agg(F.collect_list("x").alias("ox"), F.collect_list("y").alias("oy"))

    def simplified(batches):
        for batch in batches:
            column = lambda name, i: np.array(batch.column(name)[i].as_py() or [], float)  # noqa: B023, E731
            xs, ys = [], []
            for i in range(batch.num_rows):
                chain = np.stack([column("xs", i), column("ys", i)], 1)
                others = np.stack([column("ox", i), column("oy", i)], 1)
                own = {*map(tuple, chain.tolist())}
                others = others[[tuple(p) not in own for p in others.tolist()]] if len(others) else others
                least = 4 if batch.column("closed")[i].as_py() else 3 if batch.column("twin")[i].as_py() else 2
                chain = chain[simplify_arc(chain, others, tolerance, least)]
                xs.append(chain[:, 0])
                ys.append(chain[:, 1])
            yield pa.RecordBatch.from_arrays([batch.column("arc"), pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.list_(pa.float64()))], ["arc", "xs", "ys"])

    done = arcs.join(near, "arc", "left").mapInArrow(simplified, "arc string, xs array<double>, ys array<double>")
    turned = lambda c: F.when(F.col("turned"), F.reverse(c)).otherwise(F.col(c))
    line = F.arrays_zip(turned("xs").alias("x"), turned("ys").alias("y"))
    back = pieces.drop("xs", "ys").join(done, "arc").select(key, "part", "ring", "nth", line.alias("line"))
    # arcs end where the next begins: each brings all but its last point, and the ring its first one again
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda a: F.slice(a["line"], 1, F.size(a["line"]) - 1)))
    rings = back.groupBy(key, "part", "ring").agg(joined.alias("open")).select(key, "part", "ring", F.concat("open", F.slice("open", 1, 1)).alias("closed"))
    parts = rings.groupBy(key, "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "closed"))), lambda r: r["closed"]).alias("rings"))
    shapes = parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "rings"))), lambda p: p["rings"]).alias("_rings"))
    return polygons.join(shapes, key, "left").withColumn("rings", F.coalesce("_rings", "rings")).select(*polygons.columns)
