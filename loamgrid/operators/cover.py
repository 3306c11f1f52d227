"""Tables of the tiles that polygons cover, and the joins on them.

A polygon is one row for each tile of its cover (see ``functions.tiles``): tiles
wholly inside carry nothing, border tiles their own few edges. What is shuffled
or broadcast follows the borders, and no ring travels with a pair. Covers are
written to the shared folder before they are joined: their levels and their size
are then known, and they are worked out once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Shapes, arrow_function, clean_shapes, edges_meet, strip_areas
from ..functions.tiles import Cover, inside_tiles, spread
from ..sources.tables import stored

#: Edges of a border tile from which it is cut further; the level at which cutting ends.
MOST, DEEPEST = 24, -2
#: Vertices worked on together.
VERTICES = 1 << 18
BOX = ("minx", "miny", "maxx", "maxy")


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch whose rings hold about VERTICES vertices."""
    shapes = Shapes(batch.column("rings"))
    ends = shapes.rings[shapes.polygons[shapes.rows[1:]]]
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + VERTICES, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def _lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """Flat lists of n rows: ``values`` (m, k) belong to ``rows``, which are in order."""
    ends = np.searchsorted(rows, np.arange(n + 1)) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.reshape(-1)))


def _kinds(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "rings")


def tile_index(x: Column, side: float) -> Column:
    return F.floor(x / F.lit(float(side))).cast("long")


def point_cover(polygons: DataFrame, cell_m: float) -> DataFrame:
    """Polygons without rings, once for each tile: level, ix, iy, ``known`` (inside at the tile's foot), ``right`` (its right side), n_edges and edges.

    The box of the polygon is added as minx, miny, maxx and maxy.
    """

    def run(batches):
        for whole in batches:
            for batch in _slices(whole):
                cover = Cover(Shapes(batch.column("rings")), cell_m, MOST, DEEPEST)
                names = [n for n in batch.schema.names if n != "rings"]

                def rows(owner, level, ix, iy, known, edges):
                    side = cover.side(level)
                    n = pc.divide(pc.list_value_length(edges), 4).cast(pa.int32())
                    columns = [pa.array(np.full(len(owner), level, np.int32)), pa.array(ix), pa.array(iy), pa.array(known), pa.array((ix + 1) * side), n, edges]
                    taken = [batch.column(k).take(pa.array(owner)) for k in names]  # noqa: B023
                    return pa.RecordBatch.from_arrays([*taken, *(pa.array(cover.boxes[owner, k]) for k in range(4)), *columns], [*names, *BOX, "level", "ix", "iy", "known", "right", "n_edges", "edges"])  # noqa: B023

                for level, (owner, ix, iy) in cover.inner.items():
                    yield rows(owner, level, ix, iy, np.ones(len(owner), bool), _lists(np.zeros(0, np.int64), np.zeros((0, 4)), len(owner)))
                for level, tiles in cover.border.items():
                    yield rows(tiles.owner, level, tiles.ix, tiles.iy, cover.known(tiles, cover.side(level)), _lists(tiles.tile, cover.edges[tiles.edge], len(tiles)))

    kinds = f"{_kinds(polygons)}, {', '.join(f'{k} double' for k in BOX)}, level int, ix long, iy long, known boolean, right double, n_edges int, edges array<double>"
    return polygons.mapInArrow(run, kinds)


@arrow_function("boolean", once=True)
def _inside(edges: pa.Array, known: pa.Array, right: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
    flat = edges.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
    row = spread(pc.fill_null(edges.value_lengths(), 0).to_numpy(zero_copy_only=False) // 4)[0]
    value = lambda a: a.to_numpy(zero_copy_only=False)
    return pa.array(inside_tiles(flat, row, value(known), value(right), value(x), value(y)))


def with_tiles(points: DataFrame, cell_m: float, levels: list[int]) -> DataFrame:
    """Adds the tile (level, ix, iy) of each point, once for each of ``levels``."""
    key = lambda k: F.struct(F.lit(k).alias("level"), *[tile_index(F.col(c), cell_m * 8.0**k).alias(f"i{c}") for c in "xy"])
    if len(levels) == 1:
        return points.withColumns({n: key(levels[0])[n] for n in ("level", "ix", "iy")})
    return points.withColumn("_tile", F.explode(F.array(*map(key, levels)))).select("*", "_tile.*").drop("_tile")


def points_in_cover(points: DataFrame, cover: DataFrame, cell_m: float, levels: list[int]) -> DataFrame:
    """Every point with every polygon of a cover that holds it; boundary points with none."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    # the box decides most pairs, in generated code, before any edge is looked at
    boxed = (x > F.col("minx")) & (x < F.col("maxx")) & (y > F.col("miny")) & (y < F.col("maxy"))
    met = with_tiles(points, cell_m, levels or [0]).join(cover, ["level", "ix", "iy"]).filter(boxed)
    found = met.filter(_inside("edges", "known", "right", x, y))
    return found.drop("level", "ix", "iy", "known", "right", "n_edges", "edges", "minx", "miny", "maxx", "maxy")


# --- pairs of shapes ----------------------------------------------------------


def pair_cover(shapes: DataFrame, key: str, cell_m: float) -> DataFrame:
    """(key, level, ix, iy, inner, m2, pieces, edges): what of each shape lies in each tile, and the box of the shape cut to the tile.

    Shapes that cross themselves are repaired first.
    """

    def run(batches):
        for whole in batches:
            for batch in _slices(whole):
                cover = Cover(Shapes(clean_shapes(batch.column("rings"))), cell_m, 1 << 40, 0)
                names = [key, "level", "ix", "iy", "inner", *BOX, "m2", "pieces", "edges"]

                def rows(owner, level, ix, iy, inner, m2, pieces, edges):
                    n, side, box = len(owner), cover.side(level), cover.boxes[owner]  # noqa: B023
                    low, high = np.stack([ix, iy], 1) * side, (np.stack([ix, iy], 1) + 1) * side
                    cut = np.hstack([np.maximum(low, box[:, :2]), np.minimum(high, box[:, 2:])])
                    return pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(owner)), pa.array(np.full(n, level, np.int32)), pa.array(ix), pa.array(iy), pa.array(np.full(n, inner)), *map(pa.array, cut.T.copy()), pa.array(m2), pieces, edges], names)  # noqa: B023

                none = np.zeros(0, np.int64)
                for level, (owner, ix, iy) in cover.inner.items():
                    n = len(owner)
                    yield rows(owner, level, ix, iy, True, np.full(n, cover.side(level) ** 2), _lists(none, np.zeros((0, 5)), n), _lists(none, np.zeros((0, 4)), n))
                for level, tiles in cover.border.items():
                    tile, pieces = cover.pieces(tiles, level)
                    m2 = np.bincount(tile, pieces[:, 4] * (pieces[:, 1] - pieces[:, 0]) * (pieces[:, 2] + pieces[:, 3]) / 2, len(tiles))
                    yield rows(tiles.owner, level, tiles.ix, tiles.iy, False, m2, _lists(tile, pieces, len(tiles)), _lists(tiles.tile, cover.edges[tiles.edge], len(tiles)))

    kind = shapes.schema[key].dataType.simpleString()
    table = f"`{key}` {kind}, level int, ix long, iy long, inner boolean, {', '.join(f'{k} double' for k in BOX)}, m2 double, pieces array<double>, edges array<double>"
    return shapes.select(key, "rings").mapInArrow(run, table)


def _meeting(side: float):
    """Area that two border tiles' shapes share there; null where they do not even touch."""

    @arrow_function("double", once=True)
    def run(pieces_a: pa.Array, edges_a: pa.Array, pieces_b: pa.Array, edges_b: pa.Array) -> pa.Array:
        def rows(column, k):
            flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            return flat, spread(pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False) // k)[0]

        n = len(pieces_a)
        (p, row_p), (q, row_q) = rows(pieces_a, 5), rows(pieces_b, 5)
        # strips left of pieces are strips below lines, with x and y changed over
        m2 = strip_areas(p[:, [0, 2, 1, 3]], row_p, p[:, 4], q[:, [0, 2, 1, 3]], row_q, q[:, 4], n)
        out = np.maximum(m2, 0)
        (e, row_e), (f, row_f) = rows(edges_a, 4), rows(edges_b, 4)
        thin = out <= 1e-13 * side * side  # what shares more than rounding meets
        start_e, start_f = np.searchsorted(row_e, np.arange(n + 1)), np.searchsorted(row_f, np.arange(n + 1))
        apart = np.zeros(n, bool)
        for i in np.flatnonzero(thin & pc.is_valid(pieces_a).to_numpy(zero_copy_only=False)).tolist():
            apart[i] = not edges_meet(e[start_e[i] : start_e[i + 1]], f[start_f[i] : start_f[i + 1]])
        return pa.array(out, mask=apart)

    return run


def _with_ancestors(cover: DataFrame, levels: list[int], name: str) -> DataFrame:
    """Each tile under its own key and those of the larger tiles that hold it, as far as there are such levels."""
    at = lambda k, c: F.expr(f"CASE WHEN level <= {k} THEN shiftright({c}, 3 * greatest({k} - level, 0)) END")
    key = lambda k: F.when(F.col("level") <= k, F.struct(F.lit(k).alias("level"), at(k, "ix").alias("ix"), at(k, "iy").alias("iy")))
    keys = F.array_compact(F.array(*map(key, levels)))
    own = F.struct("level", "inner", *BOX, "m2", F.when(~F.col("inner"), F.col("pieces")).alias("pieces"), F.when(~F.col("inner"), F.col("edges")).alias("edges"))
    return cover.select(cover.columns[0], own.alias(name), F.explode(keys).alias("tile"))


def meeting_pairs(a: DataFrame, b: DataFrame, cell_m: float, a_id: str, b_id: str, together: str | None = None) -> DataFrame:
    """(a_id, b_id, m2) of every two shapes that touch, with the square metres they share.

    ``a`` and ``b`` have rings and an id, which is unique. Shapes meet tile by
    tile: there each brings only its part, and the parts' areas add up. Pairs are
    partitioned by ``together``, one of the ids, where it is named.
    """
    p, q = stored(pair_cover(a, a_id, cell_m), "cover"), stored(pair_cover(b, b_id, cell_m), "cover")
    levels = sorted(r["level"] for r in p.select("level").union(q.select("level")).distinct().collect()) or [0]  # a dozen at most
    met = _with_ancestors(p, levels, "p").join(_with_ancestors(q, levels, "q"), "tile")
    met = met.filter((F.col("p.level") == F.col("tile.level")) | (F.col("q.level") == F.col("tile.level")))
    # boxes decide most pairs of a tile, in generated code, before a part is looked at
    met = met.filter((F.col("p.minx") <= F.col("q.maxx")) & (F.col("q.minx") <= F.col("p.maxx")) & (F.col("p.miny") <= F.col("q.maxy")) & (F.col("q.miny") <= F.col("p.maxy")))
    both = ~F.col("p.inner") & ~F.col("q.inner")
    part = lambda c: F.when(both, F.col(c))
    border = _meeting(float(cell_m))(part("p.pieces"), part("p.edges"), part("q.pieces"), part("q.edges"))
    within = F.when(F.col("p.inner") & (F.col("p.level") >= F.col("q.level")), F.col("q.m2")).when(F.col("q.inner") & (F.col("q.level") >= F.col("p.level")), F.col("p.m2")).when(F.col("p.inner"), F.col("q.m2")).otherwise(F.col("p.m2"))
    m2 = F.when(both, F.col("_border")).otherwise(F.greatest(within, F.lit(0.0)))
    shared = met.withColumn("_border", border).select(a_id, b_id, m2.alias("m2")).filter("m2 is not null")
    if together:
        shared = shared.repartition(together)
    return shared.groupBy(a_id, b_id).agg(F.sum("m2").alias("m2"))
