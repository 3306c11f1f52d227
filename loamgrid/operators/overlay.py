"""Points in polygons by an equi-join on tiles, and the overlay built on it.

A polygon is listed under the tiles of its cover (see ``operators.cover``): those
wholly inside settle a point at once, border tiles by their own few edges. A
point's tile is arithmetic. Nothing of a polygon but its border's edges is
shuffled, and the join may be broadcast or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rings as R
from ..functions.geometry import intersection, shapes_intersect
from ..functions.legend import is_agricultural, land_cover_name
from ..sources.tables import stored, written
from .cover import meeting_pairs, point_cover, points_in_cover, tile_index

#: Polygons up to which a cover is broadcast.
BROADCAST_POLYGONS = 250_000
#: Tiles and edges up to which it is: the table's real size.
BROADCAST_TILES, BROADCAST_EDGES = 2_000_000, 5_000_000
KEY = ["mukey", "musym", "areasymbol", "crop_code", "drought_class"]


def assign_cell(points: DataFrame, cell_m: float) -> DataFrame:
    """Adds the cell (cx, cy) of each point."""
    return points.withColumn("cx", tile_index(F.col("x"), cell_m)).withColumn("cy", tile_index(F.col("y"), cell_m))


def bounds(points: DataFrame) -> DataFrame:
    """One row minx, miny, maxx, maxy."""
    return points.agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"))


def assign_block(points: DataFrame, n: int) -> DataFrame:
    """Adds (bx, by_) of an n x n grid over the points' bounds; half-open blocks, the last ones closed."""
    box = bounds(points)
    at = lambda v, lo, hi: F.least(F.lit(n - 1), F.floor((v - lo) * n / F.greatest(hi - lo, F.lit(1)))).cast("int")
    joined = points.crossJoin(F.broadcast(box))  # one row of bounds
    return joined.withColumn("bx", at(F.col("x"), F.col("minx"), F.col("maxx"))).withColumn("by_", at(F.col("y"), F.col("miny"), F.col("maxy"))).drop("minx", "miny", "maxx", "maxy")


def _box_cells(cell_m: float) -> Column:
    xs = F.sequence(tile_index(F.col("minx"), cell_m), tile_index(F.col("maxx"), cell_m))
    ys = F.sequence(tile_index(F.col("miny"), cell_m), tile_index(F.col("maxy"), cell_m))
    return F.flatten(F.transform(xs, lambda cx: F.transform(ys, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def choose_strategy(polygons: int, tiles: int, edges: int, force: str | None = None) -> str:
    """``broadcast`` while polygons, tiles and edges are few enough, else ``partitioned``; a forced broadcast beyond that is refused."""
    fits = polygons <= BROADCAST_POLYGONS and tiles <= BROADCAST_TILES and edges <= BROADCAST_EDGES
    if force == "broadcast" and not fits:
        raise ValueError(f"{polygons} polygons in {tiles} tiles with {edges} edges are too many to broadcast")
    return force or ("broadcast" if fits else "partitioned")


def point_in_polygon_join(points: DataFrame, polygons: DataFrame, cell_m: float = 3000, strategy: str | None = None) -> DataFrame:
    """Every point with every polygon that holds it (boundary points with none); the point's and the polygon's columns without rings."""
    cover = stored(point_cover(polygons, cell_m), "cover")
    size = cover.agg(F.count("*").alias("tiles"), F.coalesce(F.sum("n_edges"), F.lit(0)).alias("edges"), F.collect_set("level").alias("levels")).first()
    # a polygon has a tile at least: only a cover of many tiles needs its polygons counted
    many = polygons.count() if size["tiles"] > BROADCAST_POLYGONS else size["tiles"]
    if choose_strategy(many, size["tiles"], size["edges"], strategy) == "broadcast":
        cover = F.broadcast(cover)
    return points_in_cover(points, cover, cell_m, sorted(size["levels"]))


def overlay_counts(joined: DataFrame) -> DataFrame:
    """Pixels for each map unit, crop and drought class; tasks add up before the shuffle."""
    return joined.groupBy(*KEY).agg(F.count("*").alias("pixels"))


def enrich(counts: DataFrame) -> DataFrame:
    """Acres, land-cover name and the farmed flag of each overlay row."""
    return counts.withColumn("acres", F.round(F.col("pixels") * R.ACRES_PER_PIXEL, 3)).withColumn("land_cover", land_cover_name(F.col("crop_code"))).withColumn("is_agricultural", is_agricultural(F.col("crop_code")))


def build_overlay(points: DataFrame, polygons: DataFrame, cell_m: float = 3000, strategy: str | None = None) -> DataFrame:
    """The overlay of land-cover points and soil polygons (with drought_class)."""
    return enrich(overlay_counts(point_in_polygon_join(points, polygons, cell_m, strategy)))


def chunked_counts(points: DataFrame, polygons: DataFrame, n: int, cell_m: float = 3000) -> DataFrame:
    """The counts block by block and then over blocks: one job, where a loop over blocks would run one each."""
    joined = point_in_polygon_join(assign_block(points, n), polygons, cell_m)
    parts = joined.groupBy("bx", "by_", *KEY).agg(F.count("*").alias("pixels"))
    return parts.groupBy(*KEY).agg(F.sum("pixels").alias("pixels"))


def clip_to_bbox(shapes: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Shapes cut to a rectangle; what lies outside goes."""
    frame = R.rectangle(*[F.lit(float(v)) for v in box])
    return shapes.withColumn("rings", intersection(F.col("rings"), frame)).filter(F.size("rings") > 0)


def intersecting(shapes: DataFrame, aoi: Column) -> DataFrame:
    """Shapes that touch the area, by box first."""
    own, other = R.bbox(F.col("rings")), R.bbox(aoi)
    names = ("minx", "miny", "maxx", "maxy")
    near = R.bbox_overlaps(tuple(own[k] for k in names), tuple(other[k] for k in names))
    return shapes.filter(near).filter(shapes_intersect(F.col("rings"), aoi))


def content_key(*columns: Column) -> Column:
    """A digest of what columns hold: the same however often and wherever it is worked out."""
    return F.sha2(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)])).cast("binary"), 256)


def attach_drought(soils: DataFrame, drought: DataFrame | None, cell_m: float = 30_000) -> DataFrame:
    """Soil polygons with the worst drought class that they touch, -1 for none.

    Polygons equal in geometry, mukey, musym and areasymbol collapse into one
    here; without a drought layer nothing collapses.
    """
    if drought is None:
        return soils.withColumn("drought_class", F.lit(-1))
    # equal ones are found by a digest of their content, the least polygon_id stands for them; a zone's key is its content too
    key = [content_key(F.col("rings")).alias("_shape"), "mukey", "musym", "areasymbol"]
    others = [n for n in soils.columns if n not in ("mukey", "musym", "areasymbol")]
    least = soils.groupBy(*key).agg(F.min_by(F.struct(*others), "polygon_id").alias("_rest"))
    soils = stored(least.select("mukey", "musym", "areasymbol", "_rest.*").select(*soils.columns), "soils")  # covered and joined again
    zones = stored(drought.select(content_key(F.col("rings"), F.col("drought_class")).alias("zone_id"), "drought_class", "rings").dropDuplicates(["zone_id"]), "zones")
    touched = meeting_pairs(soils, zones, cell_m, "polygon_id", "zone_id").join(zones.select("zone_id", "drought_class"), "zone_id")
    worst = touched.groupBy("polygon_id").agg(F.max("drought_class").alias("drought_class"))
    return soils.join(worst, "polygon_id", "left").withColumn("drought_class", F.coalesce("drought_class", F.lit(-1)).cast("int"))


def polygon_crop_counts(points: DataFrame, polygons: DataFrame, cell_m: float = 3000) -> DataFrame:
    """Pixels for each polygon and crop: what a drought refresh starts from."""
    return point_in_polygon_join(points, polygons, cell_m).groupBy("polygon_id", "crop_code").agg(F.count("*").alias("pixels"))


def stored_counts(points: DataFrame, polygons: DataFrame, path: str, cell_m: float = 3000) -> DataFrame:
    """``polygon_crop_counts`` published at ``path``: points are joined by the first run that asks, and read by none after it."""
    spark = points.sparkSession
    if not written(spark, path):
        polygon_crop_counts(points, polygons, cell_m).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def refresh_drought(counts: DataFrame, soils_drought: DataFrame) -> DataFrame:
    """The overlay for another week's drought, without joining points again."""
    attrs = soils_drought.select("polygon_id", "mukey", "musym", "areasymbol", "drought_class")
    return enrich(counts.join(attrs, "polygon_id").groupBy(*KEY).agg(F.sum("pixels").alias("pixels")))


def unmatched(points: DataFrame, polygons: DataFrame, cell_m: float = 3000, key: str = "pixel_id") -> DataFrame:
    """Points in no polygon."""
    return points.join(point_in_polygon_join(points, polygons, cell_m).select(key).distinct(), key, "left_anti")


def match_multiplicity(points: DataFrame, polygons: DataFrame, prefix: str, cell_m: float = 3000, key: str = "pixel_id") -> DataFrame:
    """Points matched only inside survey areas of ``prefix``, only outside, or both."""
    inside = F.col("areasymbol").startswith(prefix)
    flags = point_in_polygon_join(points, polygons, cell_m).groupBy(key).agg(F.max(inside).alias("i"), F.max(~inside).alias("o"))
    where = F.when(F.col("i") & F.col("o"), "both").when(F.col("i"), "inside").otherwise("outside")
    return flags.groupBy(where.alias("matched")).agg(F.count("*").alias("points"))


def block_profile(points: DataFrame, polygons: DataFrame, size_m: float) -> DataFrame:
    """Points, polygons, vertices, large boxes and covered box share of every block, to see skew before a run."""
    p = assign_cell(points, size_m).groupBy("cx", "cy").agg(F.count("*").alias("points"))
    boxed = R.with_bbox(polygons).withColumn("vertices", F.size(F.flatten(F.flatten("rings"))))
    box_m2 = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))
    cells = boxed.withColumn("share", box_m2 / (size_m * size_m)).select("share", "vertices", F.explode(_box_cells(size_m)).alias("c"))
    g = cells.groupBy(F.col("c.cx").alias("cx"), F.col("c.cy").alias("cy")).agg(
        F.count("*").alias("polygons"), F.sum("vertices").alias("vertices"), F.sum((F.col("share") > 0.1).cast("int")).alias("large"), F.sum("share").alias("box_share")
    )
    return p.join(g, ["cx", "cy"], "full_outer").fillna(0, ["points", "polygons", "vertices", "large", "box_share"])


def match_report(points: DataFrame, overlay: DataFrame) -> DataFrame:
    """One row: points, matched join rows, match rate in percent, overlay rows, compression."""
    total = points.agg(F.count("*").alias("points"))
    found = overlay.agg(F.coalesce(F.sum("pixels"), F.lit(0)).alias("matched"), F.count("*").alias("overlay_rows"))
    rate = F.round(100.0 * F.col("matched") / F.nullif(F.col("points"), F.lit(0)), 3)
    return total.crossJoin(found).withColumn("match_rate", rate).withColumn("compression", F.round(1.0 * F.col("matched") / F.nullif(F.col("overlay_rows"), F.lit(0)), 3))


def scanline_counts(points: DataFrame, polygons: DataFrame, pixel: float = 30, x0: float = 0, y0: float = 0) -> DataFrame:
    """Pixels for each polygon and crop by a second method: row spans.

    Each row of pixel centres cuts a polygon's edges at sorted x; between the
    first and second, third and fourth cut and so on lies the inside. Rows and
    columns are joined, no polygon test is made. (x0, y0) is a pixel centre.
    """
    e = polygons.select("polygon_id", F.explode(R.edges(F.col("rings"))).alias("e")).select("polygon_id", "e.*").filter("y1 != y2")
    row = lambda y, up: (F.ceil if up else F.floor)((y - y0) / pixel).cast("long")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    cut = e.filter(row(low, True) <= row(high, False)).withColumn("r", F.explode(F.sequence(row(low, True), row(high, False)))).withColumn("y", F.col("r") * pixel + y0).filter((F.col("y") >= low) & (F.col("y") < high))
    x = F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    rows = cut.groupBy("polygon_id", "r").agg(F.array_sort(F.collect_list(x)).alias("xs"))
    spans = rows.withColumn("i", F.explode(F.sequence(F.lit(0), (F.size("xs") / 2 - 1).cast("int")))).select("polygon_id", "r", F.get("xs", F.col("i") * 2).alias("a"), F.get("xs", F.col("i") * 2 + 1).alias("b"))
    first, last = (F.floor((F.col("a") - x0) / pixel) + 1).cast("long"), (F.ceil((F.col("b") - x0) / pixel) - 1).cast("long")
    pixels = spans.filter(first <= last).select("polygon_id", "r", F.explode(F.sequence(first, last)).alias("c"))
    at = points.select(F.floor((F.col("y") - y0) / pixel).cast("long").alias("r"), F.floor((F.col("x") - x0) / pixel).cast("long").alias("c"), "crop_code")
    met = at.join(pixels, ["r", "c"])
    edge = polygons.select("polygon_id", F.explode(R.edges(F.col("rings"))).alias("e")).select("polygon_id", "e.*").filter("y1 = y2")
    flat = edge.withColumn("r", (F.col("y1") - y0) / pixel).filter("r = floor(r)")
    on = flat.select("polygon_id", F.col("r").cast("long").alias("r"), F.explode(F.sequence(F.ceil((F.least("x1", "x2") - x0) / pixel).cast("long"), F.floor((F.greatest("x1", "x2") - x0) / pixel).cast("long"))).alias("c"))
    return met.join(on.distinct(), ["polygon_id", "r", "c"], "left_anti").groupBy("polygon_id", "crop_code").agg(F.count("*").alias("pixels"))
