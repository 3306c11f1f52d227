"""Every registered query of the land jobs: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import legend, links
from ..functions import rings as R
from ..functions.albers import to_4326, to_5070
from ..functions.geometry import repaired, rings_to_wkb, simplified, wkb_srid, wkb_to_rings
from ..functions.numbers import rounded
from ..operators import fields as FL
from ..operators import overlay as O
from ..operators import prepare as P
from ..operators import reports as RP
from ..operators.insight import headline_counts
from ..operators.simplify import simplify_layer
from ..sources import tables as T
from . import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _round(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c), d) for c, d in places.items()})


def _dry_soil(s: SparkSession, d: str) -> DataFrame:
    return O.attach_drought(X.soil(s, d), X.rectangles(s, d, "fx_drought"), 3000)


def _overlay(s: SparkSession, d: str) -> DataFrame:
    return O.build_overlay(X.points(s, d), _dry_soil(s, d), X.CELL)


def _plain_soil(s: SparkSession, d: str) -> DataFrame:
    return O.attach_drought(X.soil(s, d), None)


# --- overlay --------------------------------------------------------------


@_query
def overlay(s, d):
    return O.build_overlay(X.points(s, d), _plain_soil(s, d), X.CELL, "partitioned")


@_query
def overlay_broadcast(s, d):
    return O.build_overlay(X.points(s, d), _plain_soil(s, d), X.CELL)


@_query
def overlay_chunked(s, d):
    return O.chunked_counts(X.points(s, d), _plain_soil(s, d), 3, X.CELL)


@_query
def overlay_skew(s, d):
    joined = O.point_in_polygon_join(X.points(s, d, skew=True), _plain_soil(s, d), X.CELL, "partitioned")
    return O.overlay_counts(joined).drop("drought_class")


@_query
def overlay_drought(s, d):
    return _overlay(s, d)


@_query
def drought_refresh(s, d):
    """This week's drought on counts that are published once for these points and polygons."""
    version = T.table_version(_read(s, d, "events"), _read(s, d, "supplier"))
    counts = O.stored_counts(X.points(s, d), X.soil(s, d), T.published_folder(s, f"counts-{version}"), X.CELL)
    return O.refresh_drought(counts, _dry_soil(s, d))


@_query
def attach_drought(s, d):
    return _dry_soil(s, d).select("polygon_id", "mukey", "drought_class")


@_query
def match_report(s, d):
    return O.match_report(X.points(s, d), overlay(s, d))


@_query
def unmatched_points(s, d):
    return O.unmatched(X.points(s, d), X.soil(s, d), X.CELL).select("pixel_id", "x", "y")


@_query
def match_multiplicity(s, d):
    return O.match_multiplicity(X.points(s, d), X.soil(s, d), "CA", X.CELL)


@_query
def scanline_truth(s, d):
    return O.scanline_counts(X.points(s, d), X.soil(s, d), 30, X.X0 + 15, X.Y0 + 15)


@_query
def validate_overlay(s, d):
    soil = X.soil(s, d)
    by_unit = lambda c: c.join(soil.select("polygon_id", "mukey"), "polygon_id").groupBy("mukey", "crop_code").agg(F.sum("pixels").alias("pixels"))
    return RP.validate_overlay(by_unit(O.polygon_crop_counts(X.points(s, d), soil, X.CELL)), by_unit(scanline_truth(s, d)))


@_query
def block_profile(s, d):
    return O.block_profile(X.points(s, d), X.soil(s, d), 1500).withColumn("box_share", F.round("box_share", 6))


@_query
def assign_block(s, d):
    return O.assign_block(X.points(s, d), 4).groupBy("bx", "by_").agg(F.count("*").alias("points"))


@_query
def bounds(s, d):
    return O.bounds(X.points(s, d))


@_query
def check_bounds(s, d):
    return P.check_bounds(X.points(s, d), (X.X0, X.Y0, 0, 0), 100)


@_query
def layer_overlap(s, d):
    return P.layer_overlap(X.points(s, d), X.soil(s, d))


# --- reports --------------------------------------------------------------


@_query
def land_cover_totals(s, d):
    return RP.land_cover_totals(_overlay(s, d))


@_query
def drought_totals(s, d):
    return RP.drought_totals(_overlay(s, d))


@_query
def crop_shares(s, d):
    return RP.crop_shares(_overlay(s, d))


@_query
def acre_summary(s, d):
    return RP.acre_summary(_overlay(s, d))


@_query
def class_histogram(s, d):
    return RP.class_histogram(X.points(s, d))


@_query
def pixels_by_unit(s, d):
    return RP.pixels_by_unit(_overlay(s, d))


@_query
def top_overlaps(s, d):
    return RP.top_overlaps(_overlay(s, d))


@_query
def top_units(s, d):
    return RP.top_units(_overlay(s, d))


@_query
def dominant_cover(s, d):
    return RP.dominant_cover(_overlay(s, d)).select("mukey", "land_cover", "crop_code", "drought_class", "acres")


@_query
def mapunit_lookup(s, d):
    return RP.mapunit(_overlay(s, d), X.fixture(s, d, "fx_attr")).select("mukey", "crop_code", "drought_class", "musym", "areasymbol", "pixels", "acres", "total_acres")


@_query
def class_diff(s, d):
    o = _overlay(s, d)
    return RP.class_diff(o.filter("drought_class < 2"), o.filter("drought_class >= 2"))


@_query
def soil_profile(s, d):
    acres = F.when(F.col("polygon_id") % 6 == 0, "n/a").otherwise((F.col("polygon_id") % 50).cast("string"))
    return RP.soil_profile(X.soil(s, d).withColumn("muareaacres", acres))


@_query
def attribute_coverage(s, d):
    return RP.attribute_coverage(X.fixture(s, d, "fx_attr"), _overlay(s, d))


@_query
def hash_sample(s, d):
    return RP.hash_sample(_read(s, d, "events").select("event_id"), "event_id", 100)


@_query
def stride_sample(s, d):
    return RP.stride_sample(_read(s, d, "supplier").select("s_suppkey"), ["s_suppkey"], 7)


@_query
def latency_summary(s, d):
    return RP.latency_summary(X.fixture(s, d, "fx_requests")).withColumn("error_codes", F.array_join("error_codes", ","))


@_query
def phase_summary(s, d):
    return RP.phase_summary(RP.latency_summary(X.fixture(s, d, "fx_requests")))


@_query
def run_summary(s, d):
    runs = _read(s, d, "events").select(F.col("event_id").alias("run"), (1 + (F.col("event_id") * 7919 % 12000) / 100.0).alias("join_secs"), F.lit(1_000_000).alias("records"))
    return RP.run_summary(runs)


# --- preparation ----------------------------------------------------------


@_query
def albers_projection(s, d):
    e = F.col("event_id")
    p = _read(s, d, "events").select("event_id", (-125 + (e % 500) / 8.0).alias("lon"), (25 + (e % 239) / 10.0).alias("lat"))
    x, y = to_5070(F.col("lon"), F.col("lat"))
    p = p.select("event_id", x.alias("px"), y.alias("py"))
    lon, lat = to_4326(F.col("px"), F.col("py"))
    return p.select("event_id", F.round("px", 2).alias("x"), F.round("py", 2).alias("y"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@_query
def mukey_area(s, d):
    return _round(P.mukey_area(X.soil(s, d)), total_m2=3)


@_query
def polygon_geometry(s, d):
    """Geometry through WKB and back, with its box, kind, centre and ring check."""
    soil = X.soil(s, d).withColumn("wkb", rings_to_wkb("rings")).withColumn("rings", wkb_to_rings("wkb"))
    kind = F.when(F.size("rings") > 1, "MultiPolygon").otherwise("Polygon")
    return R.with_bbox(soil).select("polygon_id", "minx", "miny", "maxx", "maxy", kind.alias("geometry_type"), F.round(R.centroid(F.col("rings"))["x"], 3).alias("cx"), F.round(R.centroid(F.col("rings"))["y"], 3).alias("cy"), R.ring_status(F.col("rings")).alias("status"))


@_query
def dedupe_polygons(s, d):
    soil = X.soil(s, d)
    first = soil.withColumn("tile_id", F.col("polygon_id") % 4)
    again = soil.filter("polygon_id % 3 = 0").withColumn("tile_id", (F.col("polygon_id") + 1) % 4)
    return P.dedupe_polygons(P.union_tiles([first, again])).select("polygon_id", "tile_id", "mukey")


@_query
def clean_attributes(s, d):
    """An attribute table as the JSON answers it is downloaded as, read and typed again."""
    a = X.fixture(s, d, "fx_raw_attr")
    names = {"mukey": "mukey", "muname": "muname", "niccdcd": "cap_rainfed", "iccdcd": "cap_irrigated", "drclassdcd": "drainage", "aws0150wta": "water_storage", "slopegraddcp": "slope_pct"}
    row = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit(None if c == "drainage" else "none")) for c in names.values()])
    head = F.array(*map(F.lit, names))
    raw = a.select(F.to_json(F.struct(F.array(head, row, row).alias("Table"))).alias("json"))
    record = T.parse_attributes(raw)
    return P.clean_attributes(record.select(*[F.col("record")[n].alias(n) for n in names]))


@_query
def key_batches(s, d):
    b = P.key_batches(P.mukeys(_overlay(s, d)), 10)
    return b.select("batch", F.size("keys").cast("long").alias("keys"), F.get("keys", F.lit(0)).alias("first_key"))


@_query
def valid_weeks(s, d):
    w = P.valid_weeks(F.to_date("ts"))
    return _read(s, d, "events").select("event_id", w[0].alias("week0"), w[3].alias("week3"))


@_query
def labels_and_groups(s, d):
    c = F.col("crop_code")
    p = X.points(s, d).groupBy("crop_code").agg(F.count("*").alias("n"))
    return p.select("crop_code", legend.land_cover_name(c).alias("land_cover"), legend.land_cover_name(c, unknown=True).alias("label"), legend.land_cover_group(c).alias("group_id"), legend.is_agricultural(c).alias("is_agricultural"), "n")


@_query
def region_slugs(s, d):
    return _read(s, d, "part").select("p_partkey", P.slug(F.initcap("p_name")).alias("slug"))


@_query
def square_fields(s, d):
    k = F.col("c_custkey")
    half = F.element_at(F.array(*map(F.lit, [100, 200, 400, 800, 1600])), (k % 5 + 1).cast("int"))
    rings = R.square(-120 + (k % 97) / 100.0, 36 + (k % 89) / 100.0, half)
    return R.with_bbox(_read(s, d, "customer").select("c_custkey", rings.alias("rings"))).select("c_custkey", "minx", "maxy")


@_query
def square_links(s, d):
    """Links of squares drawn in degrees."""
    k = F.col("c_custkey")
    half = F.element_at(F.array(*map(F.lit, [100, 200, 400, 800, 1600])), (k % 5 + 1).cast("int"))
    rings = R.square(-120 + (k % 97) / 100.0, 36 + (k % 89) / 100.0, half)
    return _read(s, d, "customer").select("c_custkey", links.encode_links(rings).alias("link"))


@_query
def tiles_for_aoi(s, d):
    counties = X.rectangles(s, d, "fx_fields")
    ends = [F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy")]
    box = [v or 0 for v in R.with_bbox(counties).agg(*ends).first()]  # no outline touches the one tile of an empty box
    return P.tiles_for_aoi(counties, box, 1000).select("row", "col")


@_query
def raster_points(s, d):
    """Points gathered into raster tiles of one pixel row each, and read from them again."""
    p = X.points(s, d)
    row = F.floor((F.col("y") - X.Y0) / 30).cast("int")
    cell = F.struct(((F.col("x") - X.X0) / 30).cast("int").alias("c"), F.format_string("%02x", F.col("crop_code")).alias("h"))
    rows = p.groupBy(row.alias("row")).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    band = F.unhex(F.array_join(F.transform("cells", lambda x: x["h"]), ""))
    tiles = rows.select(
        F.col("row").alias("tile_id"), F.lit(0).alias("row_off"), F.lit(0).alias("col_off"), F.size("cells").alias("width"), F.lit(1).alias("height"),
        F.lit(float(X.X0)).alias("x_origin"), (X.Y0 + 30.0 * (F.col("row") + 1)).alias("y_origin"), F.lit(30.0).alias("pixel"), band.alias("band"),
    )
    return T.raster_to_points(tiles).withColumn("crop_code", F.col("crop_code").cast("int"))


@_query
def zone_area_share(s, d):
    outlines = X.rectangles(s, d, "fx_fields").withColumnRenamed("field_id", "outline_id")
    return _round(P.zone_area_share(X.rectangles(s, d, "fx_drought"), outlines, 3000), m2=2, pct=6)


@_query
def footprint_coverage(s, d):
    return _round(P.footprint_coverage(X.points(s, d), X.soil(s, d)), soil_m2=3, coverage=6)


@_query
def simplify_impact(s, d):
    soil = X.dented(s, d)
    simple = soil.withColumn("rings", simplified(F.col("rings"), 30.0))
    return _round(P.simplify_impact(soil, simple), net_pct=6, mean_abs_pct=6, worst_pct=6)


@_query
def simplified_soil(s, d):
    """Each dented square after simplification."""
    simple = X.dented(s, d).withColumn("rings", simplified(F.col("rings"), 30.0))
    return _round(simple.select("polygon_id", R.area_m2(F.col("rings")).alias("m2"), F.size(F.flatten(F.flatten("rings"))).alias("vertices")), m2=3)


@_query
def answer_change(s, d):
    """Acres of mapped soil under each field, from the soil as drawn and as simplified, in one join."""
    soil = X.dented(s, d).select("polygon_id", "rings")
    both = soil.withColumn("simple", F.lit(0)).unionByName(soil.withColumn("rings", simplified(F.col("rings"), 30.0)).withColumn("simple", F.lit(1)))
    both = both.select((F.col("polygon_id") * 2 + F.col("simple")).alias("polygon_id"), F.col("simple").cast("string").alias("mukey"), "rings")
    acres = FL.field_hits(FL.field_pairs(_fields(s, d), both, 1500)).select("field_id", "mukey", (F.col("inter_m2") / R.M2_PER_ACRE).alias("acres"))
    return _round(P.answer_diff(acres.filter("mukey = '0'"), acres.filter("mukey = '1'")), total_pct=6, median_pct=6, p95_pct=6, worst_pct=6)


@_query
def simplified_layer(s, d):
    """Each polygon of a layer of neighbours after simplification, and what the layer covers."""
    simple = simplify_layer(X.bordered(s, d), 30.0)
    return _round(simple.select("polygon_id", R.area_m2(F.col("rings")).alias("m2"), F.size(F.flatten(F.flatten("rings"))).alias("vertices")), m2=3)


# --- reading, writing, shaping ------------------------------------------------


@_query
def point_files(s, d):
    """Points written by cell and read again."""
    path = T.shared_folder(s, "points")
    T.write_points(X.points(s, d).select("x", "y", F.col("crop_code").cast("short")), path, 3000)
    return T.read_points(s, path).withColumn("crop_code", F.col("crop_code").cast("int"))


@_query
def geometry_files(s, d):
    """Soil written as WKB and read again: number, SRID and area."""
    path = T.shared_folder(s, "soil")
    X.soil(s, d).select("polygon_id", rings_to_wkb("rings", 5070).alias("geometry")).write.parquet(path)
    return T.read_geometries(s, path).select("polygon_id", wkb_srid("geometry").alias("srid"), R.area_m2(F.col("rings")).alias("m2"))


@_query
def wkt_round_trip(s, d):
    soil = X.soil(s, d).withColumn("rings", T.from_wkt(T.to_wkt(F.col("rings"))))
    return R.with_bbox(soil).select("polygon_id", "minx", "miny", "maxx", "maxy", R.area_m2(F.col("rings")).alias("m2"), F.size("rings").alias("parts"))


@_query
def published_overlay(s, d):
    """Two areas published, one of them twice, and read with the served types."""
    path = T.shared_folder(s, "served")
    o = overlay(s, d)
    west, east = o.filter("crop_code < 60"), o.filter("crop_code >= 60")
    for part, name in ((west, "west"), (east, "east"), (west, "west")):
        T.publish(part, path, name)
    return T.load_overlay(s.read.parquet(path), "aoi").withColumn("crop_code", F.col("crop_code").cast("int"))


@_query
def published_rows(s, d):
    """What each load reports that the table holds: one area, then two, then one of them anew and smaller."""
    path = T.shared_folder(s, "served")
    o = T.stored(overlay(s, d), "overlay")
    loads = [(o.filter("crop_code < 60"), "west"), (o.filter("crop_code >= 60"), "east"), (o.filter("crop_code < 20"), "west")]
    told = [T.stored(T.publish(part, path, name).withColumn("load", F.lit(k)), "told") for k, (part, name) in enumerate(loads)]
    return told[0].unionByName(told[1]).unionByName(told[2])


@_query
def written_overlay(s, d):
    """A full product, and a sampled run that must not replace it."""
    path = T.shared_folder(s, "product")
    o = overlay(s, d)
    full = T.write_overlay(o, path)
    T.write_overlay(o.filter("crop_code = 1"), path, sampled=True)
    return s.read.parquet(full).groupBy("mukey").agg(F.sum("pixels").alias("pixels"))


@_query
def swapped_axes(s, d):
    soil = P.swap_axes(X.soil(s, d))
    return R.with_bbox(soil).select("polygon_id", "minx", "miny", "maxx", "maxy")


_BOX = (X.X0 + 450, X.Y0 + 130, X.X0 + 3010, X.Y0 + 2345)


@_query
def clipped_soil(s, d):
    """Soil cut to a box."""
    cut = O.clip_to_bbox(X.soil(s, d), _BOX)
    return _round(cut.select("polygon_id", R.area_m2(F.col("rings")).alias("m2")), m2=3)


@_query
def soil_in_area(s, d):
    """Soil that touches a box."""
    return O.intersecting(X.soil(s, d), R.rectangle(*[F.lit(v) for v in _BOX])).select("polygon_id")


@_query
def layer_classes(s, d):
    return P.layer_classes(X.points(s, d), X.soil(s, d), X.CELL)


@_query
def geometry_types(s, d):
    return RP.geometry_types(X.soil(s, d))


@_query
def fraction_sample(s, d):
    """About a hundred points; which ones depends on the partitioning."""
    return RP.sample_n(X.points(s, d), 100)


@_query
def field_statuses(s, d):
    """Fields drawn well and badly, and what becomes of them."""
    return FL.validate_fields(X.drawings(s, d), projected=True).select("field_id", "status")


@_query
def repaired_fields(s, d):
    """The badly drawn fields after repair: area, parts, and what validity then says."""
    f = X.drawings(s, d).filter(R.ring_status(F.col("rings")) == "ok").withColumn("rings", repaired("rings"))
    f = FL.validate_fields(f.withColumn("parts", F.size("rings")), projected=True)
    return _round(f.select("field_id", "m2", "parts", "status"), m2=3)


@_query
def prepared_soil(s, d):
    """Soil in degrees, prepared to served metres: the area of each unit comes back."""
    soil = X.soil(s, d).withColumn("rings", R.project(F.col("rings"), inverse=True))
    return _round(P.mukey_area(P.prepare_soil(soil, 0.0)), total_m2=0)


@_query
def link_round_trip(s, d):
    """Fields drawn in degrees, as links and back."""
    f = X.rectangles(s, d, "fx_fields").withColumn("rings", R.normalise(R.project(F.col("rings"), inverse=True)))
    coded = f.withColumn("link", links.encode_links("rings")).withColumn("back", links.decode_links("link"))
    return coded.select("field_id", "link", (F.col("back") == F.col("rings")).alias("same"))


# --- fields ---------------------------------------------------------------


def _fields(s, d):
    # a field is little to read and much to work out: one small file is dealt to all cores
    fields = X.rectangles(s, d, "fx_fields").repartition(s.sparkContext.defaultParallelism, "field_id")
    return FL.validate_fields(fields, projected=True).filter("status = 'ok'")


def _pairs(s, d, fields=None):
    return FL.field_pairs(_fields(s, d) if fields is None else fields, X.soil(s, d), 1500)


def _weighted(s, d, fields=None):
    return FL.weighted_hits(FL.field_hits(_pairs(s, d, fields)), T.stored(P.mukey_area(X.soil(s, d)), "area"))


def _roverlay(s, d):
    return O.build_overlay(X.points(s, d), O.attach_drought(X.soil(s, d), X.rectangles(s, d, "fx_drought"), 3000), X.CELL)


def _breakdown(s, d):
    return FL.area_breakdown(_weighted(s, d), _roverlay(s, d))


def _features(s, d):
    units = FL.area_mapunits(T.stored(_pairs(s, d), "pairs"), _fields(s, d), X.soil(s, d), T.stored(_roverlay(s, d), "overlay"), X.fixture(s, d, "fx_attr"))
    return FL.unit_features(units)


def _soil_summary(s, d):
    return FL.soil_summary(_weighted(s, d), _roverlay(s, d), X.fixture(s, d, "fx_attr"))


def _response(s, d):
    # each is used several times: written once, and not left to what Spark finds the same
    f = T.stored(_fields(s, d), "fields")
    w, o = T.stored(_weighted(s, d, f), "weighted"), T.stored(_roverlay(s, d), "overlay")
    return FL.area_response(f, FL.field_totals(w, o, f), FL.soil_summary(w, o, X.fixture(s, d, "fx_attr")), FL.area_breakdown(w, o))


@_query
def field_measure(s, d):
    return _round(FL.validate_fields(X.rectangles(s, d, "fx_fields"), projected=True), query_acres=3).select("field_id", "status", "query_acres")


@_query
def field_hits(s, d):
    return _round(FL.field_hits(_pairs(s, d)), inter_m2=3)


@_query
def stored_field_answers(s, d):
    """Soil under each field from a table of answers that is filled in two runs: half of the fields first, then all, each twice."""
    path = T.shared_folder(s, "answers")
    soil, f = X.soil(s, d), X.rectangles(s, d, "fx_fields")

    def answer(new):
        hits = FL.field_hits(FL.field_pairs(FL.validate_fields(new, projected=True).filter("status = 'ok'"), soil, 1500))
        return hits.groupBy("field_id").agg(F.sum("inter_m2").alias("m2"), F.count("*").alias("units"))

    FL.stored_answers(f.filter("field_id % 2 = 0"), path, answer)
    return _round(FL.stored_answers(f, path, answer), m2=3)


@_query
def field_totals(s, d):
    return _round(FL.field_totals(_weighted(s, d), _roverlay(s, d), _fields(s, d)), answered_m2=3)


@_query
def field_soil_summary(s, d):
    return _round(_soil_summary(s, d), rated_m2=3, cultivable_m2=3, irrigable_m2=3, slope_pct=6, water_storage=6)


@_query
def field_breakdown(s, d):
    return _round(_breakdown(s, d), acres=4, pixels=4)


@_query
def field_groups(s, d):
    return _round(FL.group_rollup(_breakdown(s, d)), acres=4, share=6)


@_query
def field_top_crops(s, d):
    return _round(FL.top_crops(_breakdown(s, d)), acres=4, hidden_acres=4)


@_query
def field_response(s, d):
    r = _response(s, d)
    return r.select("field_id", F.round("query_acres", 3).alias("query_acres"), F.round("answered_acres", 3).alias("answered_acres"), "map_units", rounded(F.col("cultivable_share"), 4).alias("cultivable_share"), rounded(F.col("agricultural_share"), 4).alias("agricultural_share"), F.greatest(F.size(F.coalesce("breakdown", F.array())), F.lit(0)).cast("long").alias("covers"))


@_query
def field_reading(s, d):
    """The whole answer of each field as JSON."""
    r = _response(s, d)
    return r.select("field_id", "headline", F.to_json(F.struct(*[c for c in r.columns if c != "field_id"])).alias("answer"))


@_query
def headline_counts_of_fields(s, d):
    return headline_counts(_response(s, d).filter("headline is not null"))


QUERIES["headline_counts"] = QUERIES.pop("headline_counts_of_fields")


@_query
def field_mapunits(s, d):
    return _round(FL.area_mapunits(_pairs(s, d), _fields(s, d), X.soil(s, d), _roverlay(s, d), X.fixture(s, d, "fx_attr")), inter_m2=2).select("field_id", "mukey", "inter_m2", "rn", "truncated", "land_cover", "crop_code", "muname", "drainage", "slope_pct")


@_query
def field_features(s, d):
    """One GeoJSON FeatureCollection for each field."""
    return T.feature_collection(_features(s, d), "field_id", "geojson", FL.PROPERTIES, "rn", "truncated")


@_query
def field_feature_rows(s, d):
    """The collections read again: each feature's place, kind, ring and part counts, and its eleven properties."""
    kinds = "mukey string, musym string, areasymbol string, muname string, land_cover string, crop_code int, is_agricultural boolean, drought_class int, drought_label string, capability_class int, acres double"
    rows = T.read_features(field_features(s, d), "collection", kinds)
    return rows.filter("size(rings) > 0").select("field_id", (F.col("pos") + 1).alias("rn"), "truncated", *FL.PROPERTIES)


@_query
def field_answers(s, d):
    """The single values of each field's answer."""
    r = _response(s, d)
    plain = ["field_id", "map_units", "dominant_soil", "dominant_drainage", "headline"]
    places = {"query_acres": 3, "answered_acres": 3, "coverage": 4, "slope_pct": 6, "water_storage": 6, "cultivable_share": 6, "irrigable_share": 6, "rated_share": 6, "agricultural_share": 6}
    return _round(r, **places).select(*plain, *places)


@_query
def field_answer_lists(s, d):
    """Land cover and drought of each field's answer, place by place."""
    r = T.stored(_response(s, d).select("field_id", "breakdown", "drought"), "lists")
    cover = r.select("field_id", F.posexplode("breakdown").alias("pos", "x")).select("field_id", F.lit("cover").alias("kind"), "pos", F.col("x.crop_code").alias("code"), F.col("x.land_cover").alias("label"), "x.is_agricultural", "x.acres", "x.pixels", "x.share")
    dry = r.select("field_id", F.posexplode("drought").alias("pos", "x")).select("field_id", F.lit("drought").alias("kind"), "pos", F.col("x.drought_class").alias("code"), "x.label", F.lit(None).cast("boolean").alias("is_agricultural"), "x.acres", F.lit(None).cast("double").alias("pixels"), "x.share")
    return cover.unionByName(dry)


@_query
def field_findings(s, d):
    """The findings of each field's answer, in order."""
    return _response(s, d).select("field_id", F.posexplode("findings").alias("pos", "x")).select("field_id", "pos", "x.kind", "x.severity", "x.text")


@_query
def consistency(s, d):
    return _round(FL.consistency(_breakdown(s, d)), cover_acres=6, drought_acres=6)


@_query
def dedupe_fields(s, d):
    f = X.rectangles(s, d, "fx_fields")
    twice = f.unionByName(f.withColumn("field_id", -F.col("field_id")))
    drawings, keys = FL.dedupe_fields(twice)
    return drawings.agg(F.count("*").alias("drawings")).crossJoin(keys.agg(F.count("*").alias("fields")))  # one row each
