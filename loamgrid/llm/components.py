"""Connected components of an edge table by alternating stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c


def _both(edges: DataFrame) -> DataFrame:
    pairs = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
    return edges.select(pairs.alias("p")).select("p.u", "p.v")


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both(edges)
    least = near.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return near.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u")
    moved = linked.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e"))
    return moved.select("e.a", "e.b").filter("a != b").distinct()


def _unsettled(edges: DataFrame) -> bool:
    """Whether an id has two smaller neighbours, or a smaller and a larger one: else each edge (a > b) names a's component."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("up")), F.struct(F.col("b").alias("id"), F.lit(0).alias("up"))))
    ids = edges.select(ends.alias("end")).groupBy("end.id").agg(F.sum("end.up").alias("ups"), F.count("*").alias("n"))
    return bool(ids.agg(F.max((F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("ups") < F.col("n"))))).first()[0])


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id of ``edges`` (a, b); ids without an edge are not listed.

    Each round roughly halves the depth, so rounds follow the logarithm of the
    longest chain; each is written to the shared folder, which ends its lineage.
    The rounds end as soon as the edges are stars around least ids: a round more
    would change nothing, and costs the driver eight shuffles' worth of plans.
    """
    edges = c.materialize(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while _unsettled(edges):
        edges = c.materialize(_small_star(_large_star(edges)), "edges")
    ends = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ends.unionByName(ends.select(F.col("component").alias("id"), "component").distinct())
