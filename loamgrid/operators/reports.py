"""Summaries of an overlay and of the tables around it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.legend import drought_label
from ..functions.numbers import rounded
from ..sources.tables import shared_folder


def land_cover_totals(overlay: DataFrame) -> DataFrame:
    """Acres by land-cover name, in whole acres; codes of one name are one row."""
    return overlay.groupBy("land_cover", "is_agricultural").agg(F.round(F.sum("acres"), 0).alias("acres")).orderBy(F.desc("acres"), "land_cover")


def drought_totals(overlay: DataFrame) -> DataFrame:
    """Acres and share by drought class."""
    by = overlay.groupBy("drought_class").agg(F.sum("acres").alias("acres"))
    share = F.col("acres") / F.sum("acres").over(Window.partitionBy(F.lit(1)))  # a row for each class, six at most
    return by.select("drought_class", drought_label(F.col("drought_class")).alias("label"), F.round("acres", 3).alias("acres"), F.round(share, 6).alias("share"))


def crop_shares(overlay: DataFrame) -> DataFrame:
    """Acres of each crop code as a percentage of all acres."""
    by = overlay.groupBy("crop_code").agg(F.sum("acres").alias("acres"))
    share = 100 * F.col("acres") / F.sum("acres").over(Window.partitionBy(F.lit(1)))  # a row for each code
    return by.select("crop_code", F.round("acres", 3).alias("acres"), F.round(share, 4).alias("pct"))


def acre_summary(overlay: DataFrame) -> DataFrame:
    """One row: total and agricultural acres, and the percentage."""
    s = overlay.agg(F.coalesce(F.sum("acres"), F.lit(0.0)).alias("t"), F.coalesce(F.sum(F.when(F.col("is_agricultural"), F.col("acres"))), F.lit(0.0)).alias("a"))
    return s.select(F.round("t", 3).alias("total_acres"), F.round("a", 3).alias("ag_acres"), F.round(100 * F.col("a") / F.nullif("t", F.lit(0.0)), 4).alias("ag_pct"))


def class_histogram(points: DataFrame, k: int = 12) -> DataFrame:
    """The k commonest non-zero codes with count, percentage and the number of codes present."""
    by = points.filter("crop_code != 0").groupBy("crop_code").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(F.lit(1))  # a row for each code
    by = by.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(whole), 4)).withColumn("classes", F.count("*").over(whole))
    return by.orderBy(F.desc("n"), "crop_code").limit(k)


def pixels_by_unit(overlay: DataFrame, by: str = "crop_code") -> DataFrame:
    """Pixels of each map unit and ``by``, over drought classes."""
    return overlay.groupBy("mukey", by).agg(F.sum("pixels").alias("pixels"))


def top_overlaps(overlay: DataFrame, k: int = 15) -> DataFrame:
    return overlay.orderBy(F.desc("acres"), "mukey", "musym", "areasymbol", "crop_code", "drought_class").limit(k)


def top_units(overlay: DataFrame, k: int = 6) -> DataFrame:
    return overlay.groupBy("mukey").agg(F.sum("pixels").alias("pixels")).orderBy(F.desc("pixels"), "mukey").limit(k)


def dominant_cover(overlay: DataFrame) -> DataFrame:
    """The largest single overlay row of each map unit."""
    order = F.struct("acres", (-F.col("crop_code")).alias("c"), (-F.col("drought_class")).alias("d"), F.col("musym"), F.col("areasymbol"))
    best = overlay.groupBy("mukey").agg(F.max_by(F.struct("musym", "areasymbol", "land_cover", "crop_code", "is_agricultural", "drought_class", "acres"), order).alias("r"))
    return best.select("mukey", "r.*")


def mapunit(overlay: DataFrame, mukeys: DataFrame) -> DataFrame:
    """Overlay rows of the listed units with the unit's total acres."""
    found = overlay.join(mukeys.select("mukey").distinct(), "mukey", "left_semi")
    return found.withColumn("total_acres", F.round(F.sum("acres").over(Window.partitionBy("mukey")), 3))


def soil_profile(soil: DataFrame) -> DataFrame:
    """One row: polygons, units, survey areas, and the size range of muareaacres (a string)."""
    size = F.expr("try_cast(muareaacres AS double)")
    return soil.agg(
        F.count("*").alias("polygons"), F.countDistinct("mukey").alias("units"), F.countDistinct("areasymbol").alias("areas"),
        F.min(size).alias("min_acres"), F.expr("percentile(try_cast(muareaacres AS double), 0.5)").alias("median_acres"), F.max(size).alias("max_acres"),
    )


def geometry_types(soil: DataFrame) -> DataFrame:
    kind = F.when(F.size("rings") > 1, "MultiPolygon").otherwise("Polygon")
    return soil.groupBy(kind.alias("geometry_type")).agg(F.count("*").alias("n"))


def attribute_coverage(attrs: DataFrame, overlay: DataFrame) -> DataFrame:
    """One row: rows, non-null values of each attribute, and overlay units without a row."""
    names = ["cap_rainfed", "cap_irrigated", "drainage", "water_storage", "slope_pct"]
    counts = attrs.agg(F.count("*").alias("units"), *[F.count(n).alias(n) for n in names])
    missing = overlay.select("mukey").distinct().join(attrs, "mukey", "left_anti").agg(F.count("*").alias("without_row"))
    return counts.crossJoin(missing)  # one row each


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The same n rows on every run: the smallest md5 of the key."""
    return df.orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(n)


def sample_n(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """About n rows without replacement; which ones depends on the partitioning (see hash_sample)."""
    return df.sample(False, min(1.0, n / max(1, df.count())), seed)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds the place of each row in ``order``, from 0, of rows dealt to ranges: no task sees all of them.

    The ranges are fixed before they are counted: the sorted rows are written
    once, each with its range and its place there. Rows equal in ``order`` come
    in any order.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, "numbered")
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed.write.option("compression", "zstd").parquet(path)
    # the number's upper bits are the range, its lower ones the place there
    placed = spark.read.schema(placed.schema).parquet(path).withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = placed.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_range").withColumn(name, F.col("_at") + F.col("_start")).drop("_range", "_start", "_at")


def stride_sample(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Every k-th row in order, n at most, with the stride k."""
    total = df.count()
    k = max(1, total // max(1, n))
    return numbered(df, order, "rn").filter(F.col("rn") % k == 0).orderBy("rn").limit(n).withColumn("stride", F.lit(k)).drop("rn")


def latency_summary(requests: DataFrame) -> DataFrame:
    """Request log (phase, run, latency_ms, status, cached) per run: nearest-rank percentiles of what succeeded.

    Requests are counted by value in the tasks that read them; ranks are running
    sums of those counts, so no window sees the requests themselves.
    """
    key = ["phase", "run"]
    values = requests.filter("status = 200").groupBy(*key, "latency_ms").agg(F.count("*").alias("k"))
    run = Window.partitionBy(*key)
    upto = F.sum("k").over(run.orderBy("latency_ms").rowsBetween(Window.unboundedPreceding, 0))
    ranked = values.withColumn("upto", upto).withColumn("n", F.sum("k").over(run))
    at = lambda p: F.greatest(F.lit(1), F.least(F.col("n"), F.bround(p / 100 * F.col("n") + 0.5, 0).cast("long")))
    pick = lambda rank: F.max(F.when((F.col("upto") >= rank) & (F.col("upto") - F.col("k") < rank), F.col("latency_ms")))
    middle = (pick(F.floor((F.col("n") + 1) / 2)) + pick(F.floor(F.col("n") / 2) + 1)) / 2
    good = ranked.groupBy(*key).agg(
        F.max("n").alias("ok"), rounded(middle, 2).alias("p50_ms"), rounded(pick(at(95)), 2).alias("p95_ms"), rounded(pick(at(99)), 2).alias("p99_ms"),
        rounded(F.min("latency_ms"), 2).alias("min_ms"), rounded(F.max("latency_ms"), 2).alias("max_ms"),
    )
    every = requests.groupBy(*key).agg(
        F.count("*").alias("requests"), F.sum((F.col("status") != 200).cast("long")).alias("errors"), rounded(F.avg(F.col("cached").cast("double")), 4).alias("hit_rate"),
        F.array_sort(F.collect_set(F.when(F.col("status") != 200, F.col("status")))).alias("error_codes"),
    )
    return every.join(good, key, "left").withColumn("ok", F.coalesce("ok", F.lit(0)))


def phase_summary(runs: DataFrame) -> DataFrame:
    """Per phase over ``latency_summary``: the first run dropped if there are more, medians and ranges of the rest."""
    w = Window.partitionBy("phase")
    kept = runs.withColumn("first", F.min("run").over(w)).withColumn("k", F.count("*").over(w)).filter("run > first or k = 1")
    return kept.groupBy("phase").agg(
        F.count("*").alias("runs_kept"), rounded(F.expr("percentile(p50_ms, 0.5)"), 3).alias("p50_median_ms"), F.min("p50_ms").alias("p50_min_ms"), F.max("p50_ms").alias("p50_max_ms"),
        rounded(F.expr("percentile(p95_ms, 0.5)"), 3).alias("p95_median_ms"), F.sum("errors").alias("total_errors"),
    )


def run_summary(runs: DataFrame, outlier_s: float = 100.0) -> DataFrame:
    """Run timings (run, join_secs, records): outliers counted and left out; median, range, deviation, records a second."""
    good = F.col("join_secs") < outlier_s
    value = F.when(good, F.col("join_secs"))
    s = runs.agg(
        F.count("*").alias("runs"), F.sum((~good).cast("long")).alias("excluded"), F.percentile(value, F.lit(0.5)).alias("m"), F.min(value).alias("lo"), F.max(value).alias("hi"),
        F.stddev_samp(value).alias("sd"), F.max("records").alias("records"),
    )
    r = lambda c, d: F.round(c, d)
    return s.select("runs", "excluded", r("m", 3).alias("median_s"), r("lo", 3).alias("min_s"), r("hi", 3).alias("max_s"), r("sd", 4).alias("stdev_s"), r(F.col("records") / F.col("m"), 1).alias("records_per_s"))


def class_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Codes of a unit that stand in only one of two count tables (mukey, crop_code)."""
    x = a.select("mukey", "crop_code").distinct().withColumn("in_a", F.lit(True))
    y = b.select("mukey", "crop_code").distinct().withColumn("in_b", F.lit(True))
    both = x.join(y, ["mukey", "crop_code"], "full_outer").filter("in_a is null or in_b is null")
    return both.select("mukey", "crop_code", F.when(F.col("in_a"), "a").otherwise("b").alias("only_in"))


def validate_overlay(counts: DataFrame, truth: DataFrame) -> DataFrame:
    """Per unit: pixels of both (mukey, crop_code, pixels), difference, equal classes, and ok within max(3, 0.1 %)."""
    j = counts.withColumnRenamed("pixels", "p").join(truth.withColumnRenamed("pixels", "q"), ["mukey", "crop_code"], "full_outer")
    g = j.groupBy("mukey").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("pixels"), F.coalesce(F.sum("q"), F.lit(0)).alias("truth"), F.every(F.col("p").isNotNull() & F.col("q").isNotNull()).alias("same_classes"))
    delta = F.col("pixels") - F.col("truth")
    return g.withColumn("delta", delta).withColumn("ok", F.abs(delta) <= F.greatest(F.lit(3.0), 0.001 * F.col("truth")))
