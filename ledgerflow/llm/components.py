"""Connected components of links that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import durable


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every vertex points its larger (or its other) neighbours to its least one."""
    both = edges.union(edges.select("b", "a"))
    if large:
        near, far = both.toDF("u", "v"), F.col("v") > F.col("u")
    else:
        near, far = both.where("b <= a").toDF("u", "v"), F.lit(True)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = near.where(far).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.union(least.select("u", "m"))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)``: the least id reachable from each id of the links ``(a, b)``.

    Alternating large-star and small-star steps (MapReduce connected
    components); each is a few joins on the links, of which there are never more
    than at the start, and is written to the shared folder. A vertex with very
    many links is pre-aggregated to its least neighbour. Ids without a link to
    another are not listed.
    """
    edges = durable(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    while True:
        edges = durable(_stars(_stars(edges, True), False), "links")
        # Done when every vertex points to one that points nowhere.
        ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("b", F.lit(0), F.lit(1)))
        degrees = ends.groupBy("v").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
        if degrees.where("out > 1 OR (out = 1 AND into > 0)").isEmpty():
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
