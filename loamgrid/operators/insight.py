"""A rule-based reading of each field, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds of the reading.
CULTIVABLE_HIGH, CULTIVABLE_LOW = 0.50, 0.20
FARMED_HIGH, FARMED_LOW = 0.50, 0.20
IRRIGABLE_LOW = 0.50
SLOPE_ROLLING, SLOPE_STEEP = 15.0, 30.0
WATER_LOW = 8.0
COVERAGE_PARTIAL, RATED_PARTIAL = 0.95, 0.90
DROUGHT_SEVERE = 2

# Headlines.
NO_RATING = "No soil rating for this area."
CAPABLE = "Capable ground, and it is being farmed."
IDLE = "Cultivable ground, largely out of production."
MARGINAL = "Marginal ground, and used as such."
BEYOND = "Farmed well beyond what the soil alone would carry."
MIXED = "Mixed ground, partly in production."

FINDING = "struct<kind:string,severity:string,text:string>"


def pct_text(x: Column) -> Column:
    """A share as a percentage: one decimal below 10, none from there on; half-even."""
    p = F.round(x * 100, 9)  # a half is one in whatever order shares were added up
    plain = lambda d: F.replace(F.format_number(p, d), F.lit(","), F.lit(""))
    return F.concat(F.when(p < 10, plain(1)).otherwise(plain(0)), F.lit("%"))


def soil_clause(name: Column) -> Column:
    """A sentence naming the soil, without the full stops it may end in; empty for none."""
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(" Dominant soil: "), F.regexp_replace(name, r"\.+$", ""), F.lit(".")))


def _finding(on: Column, kind: str, severity, *text) -> Column:
    severity = severity if isinstance(severity, Column) else F.lit(severity)
    parts = [t if isinstance(t, Column) else F.lit(t) for t in text]
    made = F.struct(F.lit(kind).alias("kind"), severity.alias("severity"), F.concat(*parts).alias("text"))
    return F.when(on, made)


def _rounded(x: Column, places: int) -> Column:
    return F.replace(F.format_number(F.round(x, 9), places), F.lit(","), F.lit(""))


def insight(df: DataFrame) -> DataFrame:
    """Adds headline, findings, cultivable_share, rated_share.

    Takes coverage, rated_m2, cultivable_m2, irrigable_m2, answered_m2,
    agricultural_share, slope_pct, water_storage, dominant_soil,
    dominant_drainage, severe_share (D2 or worse) and drought_share (any class).
    """
    c = F.col
    rated = F.coalesce(c("rated_m2"), F.lit(0.0))
    share = lambda a, b: F.when(b != 0, a / F.nullif(b, F.lit(0.0)))
    df = df.withColumn("rated_share", F.coalesce(share(rated, c("answered_m2")), F.lit(0.0)))
    df = df.withColumn("cultivable_share", share(c("cultivable_m2"), rated)).withColumn("irrigable_share", share(c("irrigable_m2"), rated))
    near = lambda x: F.round(x, 9)  # noqa: E731  what is at a threshold is there in whatever order it was added up
    k, farmed, i = near(c("cultivable_share")), near(c("agricultural_share")), near(c("irrigable_share"))
    headline = (
        F.when(rated == 0, NO_RATING)
        .when((k >= CULTIVABLE_HIGH) & (farmed >= FARMED_HIGH), CAPABLE)
        .when((k >= CULTIVABLE_HIGH) & (farmed < FARMED_LOW), IDLE)
        .when((k < CULTIVABLE_LOW) & (farmed < FARMED_LOW), MARGINAL)
        .when((k < CULTIVABLE_LOW) & (farmed >= FARMED_HIGH), BEYOND)
        .otherwise(MIXED)
    )
    capability = (
        F.when(k == 0, "None of the rated area is USDA capability class 1–4 (capable of cultivation); all of it is class 5–8.")
        .when(k == 1, "All of the rated area is USDA capability class 1–4 (capable of cultivation).")
        .otherwise(F.concat(pct_text(k), F.lit(" of rated area is USDA capability class 1–4 (capable of cultivation); "), pct_text(1 - k), F.lit(" is class 5–8.")))
    )
    severe, dry, slope, water = c("severe_share"), c("drought_share"), near(c("slope_pct")), near(c("water_storage"))
    always = F.lit(True)
    # Fixed texts: readers compare findings by them.
    found = [
        _finding(always, "capability", "neutral", capability, soil_clause(c("dominant_soil"))),
        _finding(always, "use", "neutral", pct_text(farmed), " of land cover is agricultural."),
        _finding(
            i < IRRIGABLE_LOW, "irrigation", "note",
            F.when(i == 0, "None of the rated area can be irrigated.").otherwise(F.concat(F.lit("Only "), pct_text(i), F.lit(" of rated area carries an irrigated capability rating; the rest cannot be irrigated."))),
        ),
        _finding(
            severe > 0, "drought", "caution", pct_text(severe), " of the field is in severe drought (D2) or worse",
            F.when(farmed >= FARMED_LOW, F.concat(F.lit(", on ground that is "), pct_text(farmed), F.lit(" agricultural."))).otherwise("."),
        ),
        _finding((severe <= 0) & (dry > 0), "drought", "note", pct_text(dry), " of the field is under some drought classification (D0–D1)."),
        _finding(slope >= SLOPE_STEEP, "terrain", "caution", "Mean slope ", _rounded(slope, 0), "% — steep. Limits machinery and raises erosion risk."),
        _finding((slope >= SLOPE_ROLLING) & (slope < SLOPE_STEEP), "terrain", "note", "Mean slope ", _rounded(slope, 0), "% — rolling."),
        _finding(
            water < WATER_LOW, "water", "note", "Available water storage ", _rounded(water, 1), " cm to 150 cm — low. Crops here depend on irrigation timing rather than stored moisture.",
            F.when(F.coalesce(c("dominant_drainage"), F.lit("")) == "", "").otherwise(F.concat(F.lit(" Drainage: "), F.lower("dominant_drainage"), F.lit("."))),
        ),
        _finding(c("coverage") < COVERAGE_PARTIAL, "caveat", "note", "Only ", pct_text(c("coverage")), " of the drawn polygon fell on mapped soil; the rest is outside the survey."),
        _finding(near(c("rated_share")) < RATED_PARTIAL, "caveat", "note", pct_text(1 - c("rated_share")), " of the answered area has no capability rating — open water, rock outcrop or made land."),
    ]
    none = F.array(_finding(always, "caveat", "note", "None of the answered area carries a USDA capability rating — typically open water, rock outcrop or made land."))
    findings = F.when(rated == 0, none).otherwise(F.filter(F.array(*found), lambda f: f.isNotNull()))
    return df.withColumn("headline", headline).withColumn("findings", findings)


def headline_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("headline").agg(F.count("*").alias("fields"))
