"""From downloaded layers to the tables that are served."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rings as R
from ..functions.geometry import intersection_area, repaired
from .cover import meeting_pairs
from .overlay import content_key, point_in_polygon_join
from .reports import numbered
from .simplify import simplify_layer


def swap_axes(soil: DataFrame) -> DataFrame:
    """Latitude-first vertices to longitude-first."""
    return soil.withColumn("rings", R.swap_axes(F.col("rings")))


def union_tiles(tiles: list[DataFrame]) -> DataFrame:
    out = tiles[0]
    for t in tiles[1:]:
        out = out.unionByName(t)
    return out


def dedupe_polygons(soil: DataFrame, key: str = "polygon_id", order: str = "tile_id") -> DataFrame:
    """One row for each polygon key, that of the first tile."""
    names = [c for c in soil.columns if c not in (key, order)]
    first = soil.groupBy(key).agg(F.min_by(F.struct(order, *names), order).alias("r"))
    return first.select(key, "r.*")


def check_bounds(points: DataFrame, bbox: tuple[float, float, float, float], slack: float = 1.0) -> DataFrame:
    """One row: the least x and y, and whether both are within ``slack`` of the area's lower corner."""
    b = points.agg(F.min("x").alias("minx"), F.min("y").alias("miny"))
    return b.withColumn("ok", (F.abs(F.col("minx") - bbox[0]) <= slack) & (F.abs(F.col("miny") - bbox[1]) <= slack))


def clean_attributes(raw: DataFrame) -> DataFrame:
    """Typed attributes, one row for each mukey; what is no number becomes null."""
    num = lambda c, t: F.expr(f"try_cast(try_cast({c} AS double) AS {t})") if t == "smallint" else F.expr(f"try_cast({c} AS double)")
    typed = raw.select(
        "mukey", "muname", num("niccdcd", "smallint").alias("cap_rainfed"), num("iccdcd", "smallint").alias("cap_irrigated"), F.col("drclassdcd").alias("drainage"),
        num("aws0150wta", "double").alias("water_storage"), num("slopegraddcp", "double").alias("slope_pct"),
    )
    order = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in typed.columns])
    return typed.groupBy("mukey").agg(F.min_by(F.struct(*typed.columns[1:]), order).alias("r")).select("mukey", "r.*")


def mukeys(overlay: DataFrame) -> DataFrame:
    return overlay.select("mukey").distinct()


def key_batches(keys: DataFrame, n: int = 500, key: str = "mukey") -> DataFrame:
    """Distinct keys in order, n to a batch."""
    listed = numbered(keys.select(key).distinct(), [key], "rn")
    batch = F.floor(F.col("rn") / n).cast("int")
    return listed.groupBy(batch.alias("batch")).agg(F.array_sort(F.collect_list(key)).alias("keys"))


def valid_weeks(day: Column, n: int = 4) -> Column:
    """The n latest Tuesdays on or before a date, newest first, as yyyymmdd."""
    tuesday = F.date_sub(day, F.pmod(F.weekday(day) - 1, F.lit(7)))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.date_format(F.date_sub(tuesday, (i * 7).cast("int")), "yyyyMMdd"))


def slug(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def prepare_soil(soil: DataFrame, tolerance: float = 30.0, key: str = "polygon_id") -> DataFrame:
    """(mukey, rings in EPSG:5070): projected, simplified as a layer, repaired, empty ones dropped. ``soil`` has rings in degrees."""
    shaped = soil.filter("rings is not null").withColumn("rings", R.project(F.col("rings")))
    shaped = simplify_layer(shaped, tolerance, key)
    return shaped.withColumn("rings", repaired("rings")).filter(F.size("rings") > 0)


def mukey_area(soil: DataFrame) -> DataFrame:
    """Total square metres and number of polygons of each map unit."""
    area = soil.withColumn("m2", R.area_m2(F.col("rings")))
    return area.groupBy("mukey").agg(F.sum("m2").alias("total_m2"), F.count("*").alias("polygons"))


def simplify_impact(raw: DataFrame, simple: DataFrame, key: str = "polygon_id") -> DataFrame:
    """One row: net area bias, mean and worst absolute error, in percent."""
    a = raw.select(key, R.area_m2(F.col("rings")).alias("a"))
    b = simple.select(key, R.area_m2(F.col("rings")).alias("b"))
    e = 100 * F.abs(F.col("b") - F.col("a")) / F.nullif("a", F.lit(0.0))
    return a.join(b, key).agg((100 * (F.sum("b") - F.sum("a")) / F.sum("a")).alias("net_pct"), F.avg(e).alias("mean_abs_pct"), F.max(e).alias("worst_pct"))


def answer_diff(a: DataFrame, b: DataFrame, key: str = "field_id", value: str = "acres") -> DataFrame:
    """One row: total change and median, 95th percentile and worst absolute change of answers, in percent."""
    j = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key)
    e = 100 * F.abs(F.col("b") - F.col("a")) / F.nullif("a", F.lit(0.0))
    return j.agg((100 * (F.sum("b") - F.sum("a")) / F.sum("a")).alias("total_pct"), F.percentile(e, F.lit(0.5)).alias("median_pct"), F.percentile(e, F.lit(0.95)).alias("p95_pct"), F.max(e).alias("worst_pct"))


def tiles_for_aoi(counties: DataFrame, bbox: tuple[float, float, float, float], step: float) -> DataFrame:
    """Grid tiles over a box that touch any county: (row, col, minx, miny, maxx, maxy)."""
    spark = counties.sparkSession
    n = lambda lo, hi: max(1, int(-(-(hi - lo) // step)))
    grid = spark.range(n(bbox[0], bbox[2])).select(F.col("id").alias("col")).crossJoin(spark.range(n(bbox[1], bbox[3])).select(F.col("id").alias("row")))  # the grid itself
    x, y = F.lit(float(bbox[0])) + F.col("col") * step, F.lit(float(bbox[1])) + F.col("row") * step
    tiles = grid.select("row", "col", x.alias("minx"), y.alias("miny"), F.least(x + step, F.lit(float(bbox[2]))).alias("maxx"), F.least(y + step, F.lit(float(bbox[3]))).alias("maxy"))
    tiles = tiles.withColumn("tile_id", F.col("row") * 1_000_000 + F.col("col"))
    shapes = tiles.withColumn("rings", R.rectangle(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy")))
    outlines = counties.select(content_key(F.col("rings")).alias("county_id"), "rings").dropDuplicates(["county_id"])
    met = meeting_pairs(shapes, outlines, step, "tile_id", "county_id")
    return tiles.join(met.select("tile_id").distinct(), "tile_id", "left_semi")


def zone_area_share(zones: DataFrame, outlines: DataFrame, cell_m: float = 30_000, outline: str = "outline_id") -> DataFrame:
    """Square metres and percentage of each outline by zone class."""
    z = zones.select(content_key(F.col("rings"), F.col("drought_class")).alias("zone_id"), "drought_class", "rings").dropDuplicates(["zone_id"])
    met = meeting_pairs(outlines, z, cell_m, outline, "zone_id").join(z.select("zone_id", "drought_class"), "zone_id")
    whole = outlines.select(outline, R.area_m2(F.col("rings")).alias("total"))
    by = met.groupBy(outline, "drought_class").agg(F.sum("m2").alias("m2")).join(whole, outline)
    return by.select(outline, "drought_class", "m2", (100 * F.col("m2") / F.nullif("total", F.lit(0.0))).alias("pct"))


def layer_overlap(points: DataFrame, soil: DataFrame) -> DataFrame:
    """One row: whether the raster's footprint and the soil's meet."""
    p = points.agg(F.min("x").alias("a"), F.min("y").alias("b"), F.max("x").alias("c"), F.max("y").alias("d"))
    s = R.with_bbox(soil).agg(F.min("minx").alias("e"), F.min("miny").alias("f"), F.max("maxx").alias("g"), F.max("maxy").alias("h"))
    c = [F.col(k) for k in "abcdefgh"]
    return p.crossJoin(s).select(R.bbox_overlaps(tuple(c[:4]), tuple(c[4:])).alias("overlaps"))  # one row each


def layer_classes(points: DataFrame, soil: DataFrame, cell_m: float = 3000) -> DataFrame:
    """Land-cover codes that the soil layer's polygons really hold, with their pixels: layers may meet by box alone."""
    return point_in_polygon_join(points, soil, cell_m).groupBy("crop_code").agg(F.count("*").alias("pixels"))


def footprint_coverage(points: DataFrame, soil: DataFrame, pixel: float = 30) -> DataFrame:
    """One row: soil area inside the raster's footprint against the footprint's area."""
    b = points.agg((F.min("x") - pixel / 2).alias("a"), (F.min("y") - pixel / 2).alias("b"), (F.max("x") + pixel / 2).alias("c"), (F.max("y") + pixel / 2).alias("d"))
    met = soil.select("rings").crossJoin(F.broadcast(b)).withColumn("m2", intersection_area(F.col("rings"), R.rectangle(*[F.col(k) for k in "abcd"])))  # one footprint
    whole = (F.first("c") - F.first("a")) * (F.first("d") - F.first("b"))
    return met.agg(F.sum("m2").alias("soil_m2"), whole.alias("footprint_m2"), (F.sum("m2") / whole).alias("coverage"))


