"""What lies under each of many drawn fields, answered in one job.

Drawings that are the same after rounding are answered once, and by
``stored_answers`` once for all runs. The spatial part is one equi-join on tiles;
everything after it is keyed by field or by (field, map unit).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rings as R
from ..functions.geometry import in_degrees, intersection, self_crossing
from ..functions.legend import drought_label, group_dimension, land_cover_group
from ..functions.numbers import rounded
from ..sources.tables import stored, to_geojson, written
from .insight import insight
from .cover import meeting_pairs
from .reports import dominant_cover

MAX_ACRES, FEATURES = 100_000, 200


def capability(irrigated: Column, rainfed: Column) -> Column:
    """The irrigated class where there is one, else the rainfed one."""
    return F.coalesce(irrigated, rainfed)


def field_key(rings: Column, prefix: str = "area") -> Column:
    """A key for a drawing: hash of its coordinates rounded to six places, in this library's own text form."""
    text = F.to_json(F.map_values(F.create_map(F.lit("c"), R.normalise(rings))))
    return F.concat(F.lit(f"{prefix}:v3:"), F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def dedupe_fields(fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct drawings (field_key, rings), and which field_id has which key."""
    keyed = fields.withColumn("rings", R.normalise(F.col("rings"))).withColumn("field_key", field_key(F.col("rings")))
    return keyed.groupBy("field_key").agg(F.first("rings").alias("rings")), keyed.select("field_id", "field_key")


def stored_answers(fields: DataFrame, path: str, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The answers of ``fields`` (field_id, rings) by way of a table of answers at ``path``, keyed by drawing.

    Only drawings that the table does not know are answered: ``answer`` gets them
    as field_id (their key) and rings, and its rows are added as a part of their
    own. With none new it is not called. Fields without an answer are left out.
    """
    spark = fields.sparkSession
    drawings, keys = dedupe_fields(fields)
    known = spark.read.parquet(path).select("field_key") if written(spark, path) else None
    new = stored(drawings if known is None else drawings.join(known, "field_key", "left_anti"), "new-drawings")
    if known is None or not new.isEmpty():
        found = answer(new.withColumnRenamed("field_key", "field_id")).withColumnRenamed("field_id", "field_key")
        found.withColumn("run", F.lit(uuid.uuid4().hex)).write.mode("append").partitionBy("run").option("compression", "zstd").parquet(path)
    return keys.join(spark.read.parquet(path).drop("run"), "field_key").drop("field_key")


def validate_fields(fields: DataFrame, projected: bool = False) -> DataFrame:
    """Adds m2, query_acres and status: ok, bad_geometry, bad_ring, invalid, empty or too_large.

    Rings are in degrees unless ``projected``; they come out in EPSG:5070 metres.
    """
    ring = R.ring_status(F.col("rings"))
    df = fields.withColumn("status", ring)
    df = df.withColumn("rings", F.when(F.col("status") == "ok", F.col("rings") if projected else R.project(F.col("rings"))))
    df = df.withColumn("crossed", self_crossing("rings")).withColumn("m2", R.area_m2(F.col("rings")))
    acres = F.col("m2") / R.M2_PER_ACRE
    status = F.when(F.col("status") != "ok", F.col("status")).when(F.col("crossed"), "invalid").when(F.col("m2") <= 0, "empty").when(acres > MAX_ACRES, "too_large").otherwise("ok")
    return df.withColumn("query_acres", acres).withColumn("status", status).drop("crossed")


def field_pairs(fields: DataFrame, soil: DataFrame, cell_m: float = 3000, key: str = "field_id") -> DataFrame:
    """Fields and soil polygons that touch: field, polygon_id, mukey and the m2 in common. No ring travels with a pair.

    All pairs of a field are in one partition, so what is grouped by field later is not shuffled again.
    """
    names = stored(soil.select("polygon_id", "mukey"), "names")  # its real size decides how it is joined
    return meeting_pairs(soil, fields, cell_m, "polygon_id", key, together=key).join(names, "polygon_id")


def field_hits(pairs: DataFrame, key: str = "field_id") -> DataFrame:
    """Intersected square metres of each field and map unit."""
    return pairs.groupBy(key, "mukey").agg(F.sum("m2").alias("inter_m2"))


def weighted_hits(hits: DataFrame, area: DataFrame) -> DataFrame:
    """Adds the share of the map unit that the field covers; units without an area go."""
    return hits.join(area.select("mukey", "total_m2"), "mukey").withColumn("fraction", F.col("inter_m2") / F.nullif("total_m2", F.lit(0.0))).drop("total_m2")


def answered_units(weighted: DataFrame, overlay: DataFrame) -> DataFrame:
    return weighted.join(overlay.select("mukey"), "mukey", "left_semi")


def field_totals(weighted: DataFrame, overlay: DataFrame, fields: DataFrame) -> DataFrame:
    """answered_m2 and map_units of every field, 0 where nothing answers."""
    by = answered_units(weighted, overlay).groupBy("field_id").agg(F.sum("inter_m2").alias("a"), F.count("*").alias("n"))
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    return fields.select("field_id").join(by, "field_id", "left").select("field_id", zero("a", 0.0).alias("answered_m2"), zero("n", 0).alias("map_units"))


def soil_summary(weighted: DataFrame, overlay: DataFrame, attrs: DataFrame) -> DataFrame:
    """Rated, cultivable and irrigable area, weighted slope and water, dominant soil and drainage of each field."""
    w, a = F.col("inter_m2"), attrs.withColumn("has_row", F.lit(True))
    part = answered_units(weighted, overlay).join(a, "mukey", "left")
    when = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0.0))
    mean = lambda n: F.sum(w * F.col(n)) / F.nullif(F.sum(F.when(F.col(n).isNotNull(), w)), F.lit(0.0))
    numbers = part.groupBy("field_id").agg(
        when(F.col("has_row")).alias("rated_m2"), when(capability(F.col("cap_irrigated"), F.col("cap_rainfed")).between(1, 4)).alias("cultivable_m2"),
        when(F.col("cap_irrigated").isNotNull()).alias("irrigable_m2"), mean("slope_pct").alias("slope_pct"), mean("water_storage").alias("water_storage"),
    )
    # not limited to answered units, and units without attributes are passed over
    best = weighted.join(attrs, "mukey").groupBy("field_id").agg(F.max_by(F.struct("muname", "drainage"), F.struct("inter_m2", "mukey")).alias("b"))
    return numbers.join(best, "field_id", "left").select("*", F.col("b.muname").alias("dominant_soil"), F.col("b.drainage").alias("dominant_drainage")).drop("b")


def area_breakdown(weighted: DataFrame, overlay: DataFrame) -> DataFrame:
    """Land cover and drought of each field; row_kind tells them apart.

    The overlay is added up by map unit first, so a field meets each land cover and
    each drought class of a unit once, and not every pair of them.
    """
    key = ["land_cover", "crop_code", "is_agricultural", "drought_class"]
    sets = [[F.col(k) for k in ("mukey", *key[:3])], [F.col("mukey"), F.col("drought_class")]]
    kind = F.when(F.grouping("crop_code") == 0, "cover").otherwise("drought")
    units = overlay.groupingSets(sets, "mukey", *key).agg(kind.alias("row_kind"), F.sum("acres").alias("acres"), F.sum("pixels").alias("pixels"))
    units = stored(units, "units")  # its real size decides how it is joined
    f = F.col("fraction")
    rows = weighted.join(units, "mukey").select("field_id", *key, "row_kind", (F.col("acres") * f).alias("acres"), (F.col("pixels") * f).alias("pixels"))
    return rows.groupBy("field_id", *key, "row_kind").agg(F.sum("acres").alias("acres"), F.sum("pixels").alias("pixels"))


def group_rollup(breakdown: DataFrame) -> DataFrame:
    """Acres and share of each field by the fixed land-cover groups, in their order."""
    cover = breakdown.filter("row_kind = 'cover'").withColumn("group_id", land_cover_group(F.col("crop_code")))
    by = cover.groupBy("field_id", "group_id").agg(F.sum("acres").alias("acres"))
    share = F.col("acres") / F.nullif(F.sum("acres").over(Window.partitionBy("field_id")), F.lit(0.0))
    return by.withColumn("share", share).join(F.broadcast(group_dimension(breakdown.sparkSession)), "group_id")  # eight groups


def top_crops(breakdown: DataFrame, k: int = 8) -> DataFrame:
    """The first k cover rows of each field by acres (to a millionth, then by code), and how many more there are with how many acres."""
    w = Window.partitionBy("field_id").orderBy(rounded(F.col("acres"), 6).desc(), "crop_code")
    ranked = breakdown.filter("row_kind = 'cover'").withColumn("rn", F.row_number().over(w))
    rest = ranked.groupBy("field_id").agg(F.count(F.when(F.col("rn") > k, 1)).alias("hidden"), F.coalesce(F.sum(F.when(F.col("rn") > k, F.col("acres"))), F.lit(0.0)).alias("hidden_acres"))
    return ranked.filter(F.col("rn") <= k).select("field_id", "rn", "land_cover", "crop_code", "acres").join(rest, "field_id")


def area_response(fields: DataFrame, totals: DataFrame, soil: DataFrame, breakdown: DataFrame) -> DataFrame:
    """One row for each valid field (field_id, query_acres): totals, soil, reading, land cover and drought lists.

    A field that meets nothing is answered with coverage 0 and empty lists.
    """
    is_cover = F.col("row_kind") == "cover"
    # equal acres stay equal whatever order they were added up in, and then the code decides
    cover = F.struct((-rounded(F.col("acres"), 6)).alias("o"), "crop_code", "land_cover", "is_agricultural", "acres", "pixels")
    dry = F.struct("drought_class", "acres")
    acres = lambda c: F.sum(F.when(c, F.col("acres")))
    sums = breakdown.groupBy("field_id").agg(
        F.array_sort(F.collect_list(F.when(is_cover, cover))).alias("breakdown"), F.array_sort(F.collect_list(F.when(~is_cover, dry))).alias("drought"), acres(is_cover).alias("total"),
        acres(is_cover & F.col("is_agricultural")).alias("agricultural"), acres(~is_cover & (F.col("drought_class") >= 2)).alias("severe"), acres(~is_cover & (F.col("drought_class") >= 0)).alias("dry"),
    )
    total = F.when(F.col("total") == 0, 1.0).otherwise(F.coalesce("total", F.lit(1.0)))
    part = lambda c: F.coalesce(F.col(c) / total, F.lit(0.0))
    share = lambda x: F.bround(x["acres"] / total, 4).alias("share")
    lists = sums.select(
        "field_id",
        F.transform("breakdown", lambda x: F.struct(x["crop_code"].alias("crop_code"), x["land_cover"].alias("land_cover"), x["is_agricultural"].alias("is_agricultural"), F.bround(x["acres"], 3).alias("acres"), F.bround(x["pixels"], 1).alias("pixels"), share(x))).alias("breakdown"),
        F.transform("drought", lambda x: F.struct(x["drought_class"].alias("drought_class"), drought_label(x["drought_class"]).alias("label"), F.bround(x["acres"], 3).alias("acres"), share(x))).alias("drought"),
        part("agricultural").alias("agricultural_share"), part("severe").alias("severe_share"), part("dry").alias("drought_share"),
    )
    df = fields.select("field_id", "query_acres").join(totals, "field_id", "left").join(soil, "field_id", "left").join(lists, "field_id", "left")
    answered = F.coalesce(F.col("answered_m2"), F.lit(0.0)) / R.M2_PER_ACRE
    df = df.withColumn("coverage", F.coalesce(F.bround(F.round(answered / F.nullif("query_acres", F.lit(0.0)), 9), 4), F.lit(0.0)))
    df = df.withColumn("answered_acres", F.bround(answered, 3)).withColumn("answered", F.col("breakdown").isNotNull())
    df = df.fillna(0.0, ["agricultural_share", "severe_share", "drought_share", "rated_m2", "cultivable_m2", "irrigable_m2"])
    df = insight(df)
    keep = lambda c: F.when(F.col("answered"), F.col(c)).alias(c)
    return df.select(
        "field_id", F.bround("query_acres", 3).alias("query_acres"), F.when(F.col("answered"), F.col("answered_acres")).otherwise(0.0).alias("answered_acres"),
        F.when(F.col("answered"), F.col("coverage")).otherwise(0.0).alias("coverage"), F.when(F.col("answered"), F.col("map_units")).otherwise(0).alias("map_units"),
        "dominant_soil", "dominant_drainage", "slope_pct", "water_storage", "cultivable_share", "irrigable_share", keep("rated_share"), keep("agricultural_share"),
        keep("headline"), keep("findings"), "breakdown", "drought",
    )


def with_attributes(df: DataFrame, attrs: DataFrame) -> DataFrame:
    return df.join(attrs, "mukey", "left")


def area_mapunits(pairs: DataFrame, fields: DataFrame, soil: DataFrame, overlay: DataFrame, attrs: DataFrame, cap: int = FEATURES) -> DataFrame:
    """Clipped map units of each field, largest first, ``cap`` at most, with whether there were more.

    Units are ranked by their summed area; only the parts of those kept are clipped.
    """
    best = dominant_cover(overlay)
    met = pairs.filter("m2 > 0")
    units = field_hits(met).join(best.select("mukey"), "mukey", "left_semi")
    w = Window.partitionBy("field_id")
    ranked = units.withColumn("rn", F.row_number().over(w.orderBy(rounded(F.col("inter_m2"), 3).desc(), "mukey"))).withColumn("truncated", F.count("*").over(w) > cap)
    kept = ranked.filter(F.col("rn") <= cap)
    parts = met.join(kept.select("field_id", "mukey"), ["field_id", "mukey"], "left_semi")
    parts = parts.join(soil.select("polygon_id", F.col("rings").alias("a")), "polygon_id").join(fields.select("field_id", F.col("rings").alias("b")), "field_id")
    cut = parts.select("field_id", "mukey", "polygon_id", intersection("a", "b").alias("part"))
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("polygon_id", "part"))), lambda x: x["part"]))
    shaped = kept.join(cut.groupBy("field_id", "mukey").agg(listed.alias("rings")), ["field_id", "mukey"]).join(best, "mukey")
    found = with_attributes(shaped, attrs).withColumn("field_acres", F.col("inter_m2") / R.M2_PER_ACRE)
    return found.withColumn("geojson", to_geojson(in_degrees("rings")))


#: Properties of a map unit's feature.
PROPERTIES = ["mukey", "musym", "areasymbol", "muname", "land_cover", "crop_code", "is_agricultural", "drought_class", "drought_label", "capability_class", "acres"]


def unit_features(units: DataFrame) -> DataFrame:
    """``area_mapunits`` with the properties of its features: acres under the field to three places, the label of its drought, the preferred capability."""
    units = units.withColumn("acres", F.bround("field_acres", 3)).withColumn("drought_label", drought_label(F.col("drought_class")))
    return units.withColumn("capability_class", capability(F.col("cap_irrigated"), F.col("cap_rainfed")))


def consistency(breakdown: DataFrame) -> DataFrame:
    """Land-cover acres and drought acres of each field, and whether they agree to a millionth."""
    pick = lambda k: F.coalesce(F.sum(F.when(F.col("row_kind") == k, F.col("acres"))), F.lit(0.0))
    by = breakdown.groupBy("field_id").agg(pick("cover").alias("cover_acres"), pick("drought").alias("drought_acres"))
    return by.withColumn("ok", F.abs(F.col("cover_acres") - F.col("drought_acres")) <= 1e-6 * F.greatest(F.lit(1.0), F.col("cover_acres")))
