"""Groups of rows that hang together through shared values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..session import durable

# Rows of a list of ids that a join may broadcast.
LISTED_ROWS = 100_000


def listed(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, of which there are ``n``, as one side of a join: never broadcast if they are many.

    The engine's size checks go by the bytes of files. Ids compress so well that
    a list of them takes a hundred times that in memory, the driver's first.
    """
    return rows if n <= LISTED_ROWS else rows.hint("merge")


def split_shared(rows: DataFrame, columns: Sequence[str], also: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: those that share no value of any of the columns with another row or with ``also``, and the rest.

    Equal values have equal hashes, so a hash that only one row has tells for
    sure; rows whose hashes meet by chance just go to the rest. Eight bytes a
    value are shuffled, and the list of shared hashes is written: mostly short,
    so that ``rows``, which are read three times, stay where they are.
    """
    hashes = [F.xxhash64(F.lit(i), F.col(c)) for i, c in enumerate(columns)]
    parts = [rows] if also is None else [rows, also]
    listed = reduce(DataFrame.unionByName, [p.select(F.explode(F.array(*hashes)).alias("_h")) for p in parts])
    shared = durable(listed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h"), "shared")
    if shared.isEmpty():
        return rows, rows.where(F.lit(False))
    told, marks = rows, []
    for i, value in enumerate(hashes):
        mine = shared.select(F.col("_h").alias(f"_h{i}"), F.lit(True).alias(f"_shared{i}"))
        told = told.withColumn(f"_h{i}", value).join(mine, f"_h{i}", "left")
        marks.append(F.col(f"_shared{i}"))
    told = told.withColumn("_rest", F.coalesce(*marks, F.lit(False)))
    return told.where("NOT _rest").select(*rows.columns), told.where("_rest").select(*rows.columns)


def picked(rows: DataFrame, verdicts: DataFrame, keep: str, on: str = "event_id") -> DataFrame:
    """The rows that ``verdicts``, which lists each of them once, holds under the condition ``keep``.

    They are joined to the shorter of the two lists, so that wide rows need not
    move when nearly all or nearly none of them stay.
    """
    kept = F.coalesce(F.expr(keep), F.lit(False))
    n, every = verdicts.agg(F.count_if(kept), F.count(F.lit(1))).first()
    if 2 * n > every:
        return rows.join(listed(durable(verdicts.where(~kept).select(on), "lost"), every - n), on, "left_anti")
    return rows.join(listed(durable(verdicts.where(kept).select(on), "kept"), n), on, "left_semi")


def connected(edges: DataFrame) -> DataFrame:
    """``(id, component)`` of all ids in the links ``(a, b)``: the least id reachable.

    Each round every id takes the least label among its own and its neighbours',
    hands it on to the id that its old label names, and then follows its label
    two steps; so a chain of any length shrinks by a factor a round. Labels are
    one row per id, pre-aggregated before each shuffle, and written each round.
    """
    both = durable(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = durable(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        offered = both.join(labels, both["b"] == labels["id"]).select(F.col("a").alias("id"), "label")
        # The least label around an id, for the id itself and for the one its label names.
        around = offered.unionByName(labels).groupBy("id").agg(F.min("label").alias("least"))
        told = around.join(labels, "id").select("id", "label", "least")
        hooked = told.select("id", F.col("least").alias("label")).unionByName(told.select(F.col("label").alias("id"), F.col("least").alias("label")))
        nearer = hooked.groupBy("id").agg(F.min("label").alias("label"))
        nearer = durable(nearer, "nearer")
        for _ in range(2):
            step = nearer.select(F.col("id").alias("label"), F.col("label").alias("further"))
            nearer = nearer.join(step, "label", "left").select("id", F.least(F.col("label"), F.coalesce("further", "label")).alias("label"))
        nearer = durable(nearer, "labels")
        changed = nearer.join(labels.withColumnRenamed("label", "before"), "id").where("label <> before")
        if changed.isEmpty():
            return nearer.select("id", F.col("label").alias("component"))
        labels = nearer
