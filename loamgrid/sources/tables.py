"""Reading and writing the library's tables."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import wkb_to_rings
from ..functions.rings import RINGS, normalise

POINTS = "x int, y int, crop_code short"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/loamgrid-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def published_folder(spark: SparkSession, name: str) -> str:
    """A folder of that name which all runs share."""
    return f"{shared_folder(spark, name).rsplit('/', 2)[0]}/loamgrid-published/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder once and read from there."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def table_version(*tables: DataFrame) -> str:
    """A digest of the files that tables are read from, by name, size and time: the same as long as they are."""
    marks = []
    for t in tables:
        files = t.select(F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("h")).distinct()
        marks.append(files.agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(20,0)")).alias("h")).first())
    return hashlib.sha256(str([tuple(m) for m in marks]).encode()).hexdigest()[:16]


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Land-cover records; splits follow spark.sql.files.maxPartitionBytes, not the number of files."""
    return spark.read.schema(POINTS).parquet(path)


def read_geometries(spark: SparkSession, path: str, column: str = "geometry") -> DataFrame:
    """A table with a WKB column, and its rings; rows without a geometry are dropped."""
    return spark.read.parquet(path).filter(F.col(column).isNotNull()).withColumn("rings", wkb_to_rings(column))


def write_points(points: DataFrame, path: str, cell_m: int = 30_000) -> None:
    """Records of a cell in one part file where they fit, so that later reads of an area skip the rest."""
    cell = F.struct(F.floor(F.col("x") / cell_m), F.floor(F.col("y") / cell_m))
    points.repartition(cell).sortWithinPartitions("y", "x").write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_overlay(overlay: DataFrame, path: str, sampled: bool = False) -> str:
    """Overwrite the product; a sampled run has a folder of its own and cannot replace the full one."""
    path = f"{path.rstrip('/')}_sample" if sampled else path
    overlay.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def load_overlay(df: DataFrame, *more: str) -> DataFrame:
    """The nine served columns with their types, and any ``more`` as they are."""
    kinds = {"mukey": "string", "musym": "string", "areasymbol": "string", "crop_code": "short", "drought_class": "int", "pixels": "long", "acres": "double", "land_cover": "string", "is_agricultural": "boolean"}
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()], *more)


def publish(df: DataFrame, path: str, aoi: str) -> DataFrame:
    """Replace one area's partition and leave the others; a second run changes nothing. Returns what the table then holds: aoi, rows."""
    writer = df.withColumn("aoi", F.lit(aoi)).write.mode("overwrite").partitionBy("aoi")
    writer.option("partitionOverwriteMode", "dynamic").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path).groupBy("aoi").agg(F.count("*").alias("rows"))


def raster_to_points(tiles: DataFrame) -> DataFrame:
    """(x, y, crop_code) of every pixel with a code other than 0, at pixel centres rounded to whole metres."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                band = np.frombuffer(row["band"], np.uint8).reshape(row["height"], row["width"])
                r, col = np.nonzero(band)
                x = np.rint(row["x_origin"] + (row["col_off"] + col + 0.5) * row["pixel"]).astype(np.int32)
                y = np.rint(row["y_origin"] - (row["row_off"] + r + 0.5) * row["pixel"]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(band[r, col].astype(np.int16))], ["x", "y", "crop_code"])

    return tiles.mapInArrow(run, POINTS)


def parse_attributes(raw: DataFrame, column: str = "json") -> DataFrame:
    """One row per record of ``{"Table": [[header...], [row...]]}``, all strings; no Table means no row."""
    table = F.from_json(F.col(column), "Table array<array<string>>")["Table"]
    rows = raw.select(F.element_at(table, 1).alias("header"), F.explode(F.slice(table, 2, F.greatest(F.size(table) - 1, F.lit(0)))).alias("row"))
    return rows.select(F.map_from_arrays("header", "row").alias("record"))


def from_geojson(column: Column) -> Column:
    """Rings of a Polygon or MultiPolygon; null for anything else."""
    kind = F.get_json_object(column, "$.type")
    text = F.get_json_object(column, "$.coordinates")
    ring = "array<array<array<double>>>"
    shape = F.when(kind == "Polygon", F.array(F.from_json(text, ring))).when(kind == "MultiPolygon", F.from_json(text, f"array<{ring}>"))
    pair = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    return F.transform(shape, lambda poly: F.transform(poly, lambda r: F.transform(r, pair))).cast(RINGS)


def from_wkt(column: Column) -> Column:
    """Rings of a POLYGON or MULTIPOLYGON text, further ordinates dropped; none for an EMPTY one, null for anything else."""
    kind = F.upper(F.regexp_extract(column, r"^\s*(?:SRID=\d+;)?\s*([A-Za-z]+)", 1))
    body = F.regexp_extract(column, r"(\(.*\))", 1)
    # positions become arrays of numbers, and brackets those of JSON
    text = F.regexp_replace(body, r"\s*([-+.\deE]+)\s+([-+.\deE]+)[^,()]*", "[$1,$2]")
    text = F.translate(text, "()", "[]")
    ring = "array<array<array<double>>>"
    shape = F.when(kind == "POLYGON", F.array(F.from_json(text, ring))).when(kind == "MULTIPOLYGON", F.from_json(text, f"array<{ring}>"))
    pair = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    empty = kind.isin("POLYGON", "MULTIPOLYGON") & F.upper(column).rlike(r"POLYGON\s*(?:ZM|Z|M)?\s*EMPTY\s*$")
    rings = F.transform(F.filter(shape, lambda poly: poly.isNotNull()), lambda poly: F.transform(poly, lambda r: F.transform(r, pair)))
    return F.when(empty, F.array().cast(RINGS)).when(body != "", rings.cast(RINGS))


def to_wkt(rings: Column) -> Column:
    """MULTIPOLYGON text of rings."""
    listed = lambda parts: F.concat(F.lit("("), F.array_join(parts, ","), F.lit(")"))
    point = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    return F.concat(F.lit("MULTIPOLYGON "), listed(F.transform(rings, lambda poly: listed(F.transform(poly, lambda r: listed(F.transform(r, point)))))))


def to_geojson(rings: Column, places: int = 6) -> Column:
    """GeoJSON text, a Polygon for one part and a MultiPolygon for more."""
    pairs = F.transform(normalise(rings, places), lambda poly: F.transform(poly, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))))
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.get(pairs, F.lit(0)).alias("coordinates")))
    return F.when(F.size(rings) == 1, one).otherwise(F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), pairs.alias("coordinates"))))


def feature_collection(features: DataFrame, key: str, geojson: str, properties: list[str], order: str | None = None, truncated: str | None = None) -> DataFrame:
    """(key, collection): the rows of a key as one GeoJSON FeatureCollection, by ``order``, with the flag ``truncated`` if one is named."""
    feature = F.concat(F.lit('{"type":"Feature","geometry":'), F.col(geojson), F.lit(',"properties":'), F.to_json(F.struct(*properties), {"ignoreNullFields": "false"}), F.lit("}"))
    place = F.col(order) if order else F.lit(0)
    listed = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("o"), feature.alias("f")))), lambda x: x["f"])
    flag = F.max(F.coalesce(F.col(truncated), F.lit(False))) if truncated else F.lit(None).cast("boolean")
    by = features.groupBy(key).agg(F.concat_ws(",", listed).alias("list"), flag.alias("flag"))
    tail = F.when(F.col("flag").isNull(), "]}").otherwise(F.concat(F.lit('],"truncated":'), F.col("flag").cast("string"), F.lit("}")))
    return by.select(key, F.concat(F.lit('{"type":"FeatureCollection","features":['), F.col("list"), tail).alias("collection"))


def read_features(collections: DataFrame, column: str, properties: str) -> DataFrame:
    """A row for each feature of GeoJSON collections: ``truncated``, ``pos`` (from 0), ``geometry_type``, ``rings`` of polygons (null for
    other kinds), the ``geometry`` as text and the properties, typed as ``properties`` says. Other columns stay; what is no collection gives no row.
    """
    kind = f"type string, truncated boolean, features array<struct<geometry:string,properties:struct<{properties}>>>"
    whole = collections.withColumn("_c", F.from_json(F.col(column), kind)).filter("_c.type = 'FeatureCollection'").drop(column)
    rows = whole.select(*[n for n in whole.columns if n != "_c"], F.col("_c.truncated").alias("truncated"), F.posexplode("_c.features").alias("pos", "_f"))
    text = F.col("_f.geometry")
    return rows.select("*", F.get_json_object(text, "$.type").alias("geometry_type"), from_geojson(text).alias("rings"), text.alias("geometry"), "_f.properties.*").drop("_f")
