"""Checks of the declared constraints."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..schema import Table


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Values of a unique key held by more than one row; NULLs never clash."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    return df.where(present).groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def uniqueness_audit(df: DataFrame, table: Table) -> DataFrame:
    """``(key, values, rows)``: clashing values and rows per declared unique key."""
    parts = [
        duplicate_keys(df, key).agg(
            F.lit(",".join(key)).alias("key"), F.count(F.lit(1)).alias("values"),
            F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("rows"),
        )
        for key in table.unique
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def column_audit(df: DataFrame, table: Table) -> DataFrame:
    """``(column, nulls, too_long)`` per column in one pass; lengths in code points."""
    names = [n for n in table.struct.names if n in df.columns]
    limits, required = table.limits, set(table.required)
    sums = []
    for n in names:
        null = F.sum(F.when(F.col(n).isNull(), 1).otherwise(0)) if n in required else F.lit(0)
        long = F.sum(F.when(F.char_length(F.col(n)) > limits[n], 1).otherwise(0)) if n in limits else F.lit(0)
        sums.append(F.struct(
            F.lit(n).alias("column"),
            F.coalesce(null, F.lit(0)).cast("long").alias("nulls"),
            F.coalesce(long, F.lit(0)).cast("long").alias("too_long"),
        ).alias(n))
    return df.agg(*sums).select(F.explode(F.array(*names)).alias("c")).select("c.*")


def orphans(child: DataFrame, parent: DataFrame, column: str, parent_column: str = "id") -> DataFrame:
    """Child rows whose reference has no parent row."""
    return child.join(parent.select(F.col(parent_column).alias(column)), column, "left_anti")


def unlisted_vectors(vectors: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Vector store entries without an embedding row (the vector is written first)."""
    return vectors.join(embeddings.select("vector_id"), "vector_id", "left_anti")
