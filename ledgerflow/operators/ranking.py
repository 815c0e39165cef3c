"""Row numbers and surrogate ids that do not put a whole group into one task.

A hot group is cut at *split points*: about one row in ``every`` is picked by a
hash of the row itself, and the order values of those rows cut the group into
buckets. The choice depends on the data only, so a recomputed task makes the
same cut, and it follows the data's own distribution, so clumped order values
are cut as finely as even ones. There are about ``rows / every`` split points in
the whole input; whether they are broadcast is left to the engine's size checks.
A global numbering (no keys) gathers all of them in one array, one entry for
each two million rows, and the counts of its buckets in another; both are
written first, as their length tells how many steps a search takes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import durable

SPLIT_EVERY = 2_000_000


def split_points(df: DataFrame, keys: Sequence[str], order: str, every: int = SPLIT_EVERY) -> DataFrame:
    """``(keys, _points)``: the sorted split points of each group that has any.

    ``_points`` holds them as ``values``, next to the halving ``steps`` of a
    search over them.
    """
    picked = F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.col(order)), F.lit(every)) == 0
    values = df.where(picked & F.col(order).isNotNull()).groupBy(*keys).agg(
        F.array_sort(F.collect_set(order)).alias("values")
    )
    top = F.floor(F.log2(F.greatest(F.size("values"), F.lit(1)))).cast("int")
    steps = F.transform(F.sequence(top, F.lit(0), F.lit(-1)), lambda e: F.pow(F.lit(2), e).cast("int"))
    return values.select(*keys, F.struct("values", steps.alias("steps")).alias("_points"))


def points_below(points: Column, value: Column) -> Column:
    """How many of the sorted point values are <= ``value``, by halving steps."""
    values = points["values"]
    return F.aggregate(
        points["steps"],
        F.lit(0),
        # Beyond the end ``get`` is NULL and the position stays.
        lambda at, step: F.when(F.get(values, at + step - 1) <= value, at + step).otherwise(at),
    )


def with_bucket(df: DataFrame, keys: Sequence[str], order: str, every: int = SPLIT_EVERY) -> DataFrame:
    """Add ``_bucket`` and ``_cut``; a group without split points is one bucket, not cut."""
    joined = df.join(split_points(df, keys, order, every), list(keys), "left")
    cut = F.coalesce(F.size(F.col("_points.values")) > 0, F.lit(False))
    number = F.when(cut, points_below(F.col("_points"), F.col(order))).otherwise(0)
    return joined.select(*[F.col(c) for c in df.columns], number.alias("_bucket"), cut.alias("_cut"))


def grouped_rank(df: DataFrame, keys: Sequence[str], order: str, name: str, every: int = SPLIT_EVERY) -> DataFrame:
    """1-based position (LONG) of each row in its group, by a unique ``order`` column.

    Same result as ``row_number()``; the sort runs per (group, bucket) and the
    counts of earlier buckets are added. ``keys`` may be empty for one global
    numbering. Key columns must not be NULL.
    """
    part = list(keys)
    if not part:
        return _global_rank(df, order, name, every)
    bucketed = with_bucket(df, part, order, every)
    # Only cut groups need offsets: at most one row per split point.
    counts = bucketed.where("_cut").groupBy(*part, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counts.withColumn("_offset", F.sum("_n").over(earlier))
        .where(F.col("_offset").isNotNull())
        .select(*part, "_bucket", "_offset")
    )
    within = F.row_number().over(Window.partitionBy(*part, "_bucket").orderBy(order))
    ranked = bucketed.withColumn("_within", within).join(offsets, [*part, "_bucket"], "left")
    position = F.col("_within").cast("long") + F.coalesce(F.col("_offset"), F.lit(0))
    return ranked.select(*[F.col(c) for c in df.columns], position.alias(name))


def _global_rank(df: DataFrame, order: str, name: str, every: int) -> DataFrame:
    """``grouped_rank`` without keys.

    The search is that of ``points_below`` with a column for each step: such are
    compiled, while a fold over the steps is interpreted for every row. Offsets
    are looked up by the bucket's number; a join on it would have the optimizer
    go through all steps again and again.
    """
    points = durable(split_points(df, [], order, every).select("_points.values"), "points")
    n = points.select(F.size("values")).first()[0]
    bucketed = df.withColumns({"_values": points.scalar(), "_bucket": F.lit(0)})
    for e in reversed(range(n.bit_length())):
        at = F.col("_bucket")
        # Beyond the end ``get`` is NULL and the position stays.
        bucketed = bucketed.withColumn("_bucket", F.when(F.get("_values", at + F.lit((1 << e) - 1)) <= F.col(order), at + F.lit(1 << e)).otherwise(at))
    # Neither array may go on with the rows, which are shuffled next.
    bucketed = bucketed.drop("_values")
    if n:
        counts = durable(bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")), "counts")
        earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        buckets = df.sparkSession.range(n + 1).select(F.col("id").cast("int").alias("_bucket")).join(counts, "_bucket", "left")
        places = buckets.select("_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
        listed = F.sort_array(F.collect_list(F.struct("_bucket", "_offset")))
        offsets = durable(places.agg(F.transform(listed, lambda p: p["_offset"]).alias("offsets")), "offsets")
        bucketed = bucketed.withColumn("_offsets", offsets.scalar()).withColumn("_offset", F.get("_offsets", F.col("_bucket"))).drop("_offsets")
    else:
        bucketed = bucketed.withColumn("_offset", F.lit(0))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(order)).cast("long")
    return bucketed.select(*[F.col(c) for c in df.columns], (within + F.col("_offset")).alias(name))


def surrogate_ids(df: DataFrame, order: str, name: str = "id", taken: DataFrame | None = None, every: int = SPLIT_EVERY) -> DataFrame:
    """Dense ids in ``order``, above the largest id in ``taken`` (one column)."""
    ranked = grouped_rank(df, [], order, name, every)
    if taken is None:
        return ranked
    top = taken.agg(F.coalesce(F.max(taken.columns[0]), F.lit(0)).cast("long").alias("_top"))
    return ranked.withColumn(name, F.col(name) + top.scalar())
