"""Operator 8: shards of near-equal bytes by longest-processing-time scheduling of whole groups."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import durable

SHARDS = 16
CELL = 100_000  # groups of one size class, or rows of one shard, that are numbered in one task
MANTISSA = 12  # leading bits of a group's size that make its size class; sizes below 4096 are exact


def size_class(size: Column) -> Column:
    """``size`` with all but its leading bits cleared: at most 2**11 classes for each power of two."""
    drop = F.greatest(F.floor(F.log2(size.cast("double"))).cast("int") - (MANTISSA - 1), F.lit(0))
    unit = F.pow(F.lit(2.0), drop).cast("long")
    return (F.floor(size / unit) * unit).cast("long")


def schedule(cells: list[tuple[int, int, int, int]], shards: int) -> list[tuple[int, int, list[int], list[int]]]:
    """Longest processing time first through a heap of (load, shard).

    ``cells`` are (size class, cell, groups, bytes), from the largest class
    down. Within a cell all groups count with the cell's mean size, so those
    dealt out are told by number only: the result is (size class, cell, ends,
    shards), where the groups ranked below ``ends[i]`` and not below
    ``ends[i - 1]`` go to ``shards[i]``. While the lowest shards lie within one
    size of each other and below the rest, the heap would serve them in turn;
    such turns are dealt at once, so the work follows the cells, not the groups.
    """
    heap = [(0.0, s) for s in range(shards)]
    dealt = []
    for size, cell, groups, total in cells:
        mean = total / groups
        got = [0] * shards
        left = groups
        while left:
            ranked = sorted(heap)
            low = sum(load <= ranked[0][0] + mean for load, _ in ranked)
            room = (ranked[low][0] - ranked[low - 1][0]) // mean if low < shards else left
            turns = int(min(left // low, room))
            if turns:
                heap = [(load + turns * mean * (i < low), s) for i, (load, s) in enumerate(ranked)]
                heapq.heapify(heap)
                for _, s in ranked[:low]:
                    got[s] += turns
                left -= turns * low
            else:
                load, s = heap[0]
                heapq.heapreplace(heap, (load + mean, s))
                got[s] += 1
                left -= 1
        used = [s for s in range(shards) if got[s]]
        ends = np.cumsum([got[s] for s in used]).tolist()
        dealt.append((size, cell, ends, used))
    return dealt


def shard_documents(docs: DataFrame, shards: int = SHARDS, cell: int = CELL) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for the law ``bytes``.

    Documents with equal texts are one group and stay together; a group weighs
    the UTF-8 bytes of its copies plus one each. Groups are dealt from the
    largest size class down, each to the least-loaded shard. NULL texts form one
    group of size 1 each row, apart from empty ones; both have crc32 0. Slots
    count from 0 in each shard, by (cell, doc_id), without gaps. Repeated ids
    are rows of their own. An empty table gives no rows.

    Only narrow rows are shuffled: texts stay behind as digests. Sizes are
    pre-aggregated per group. A class with many groups is cut into cells by a
    hash, and the driver gets one line for each cell: a few thousand classes per
    power of two plus one for each ``cell`` groups. A group with very many
    copies is one line too; its rows are numbered in cells by their ids.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = durable(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            # Half a SHA-256: equal for equal texts, apart for others.
            F.when(text.isNull(), F.lit("")).otherwise(F.substring(F.sha2(text, 256), 1, 32)).alias("_text"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("_text").agg(F.sum("size").alias("_bytes")).withColumn("_class", size_class(F.col("_bytes")))
    groups = durable(groups, "shard-groups")
    parts = groups.groupBy("_class").agg(F.ceil(F.count("*") / cell).cast("long").alias("_parts"))
    # One line per size class, so its size is bounded whatever the data.
    placed = groups.join(F.broadcast(parts), "_class").withColumn("_cell", F.pmod(F.xxhash64("_text"), F.col("_parts")))
    lines = placed.groupBy("_class", "_cell").agg(F.count("*").alias("n"), F.sum("_bytes").alias("total")).collect()
    cells = sorted(((r["_class"], r["_cell"], r.n, r.total) for r in lines), key=lambda c: (-c[0], c[1]))
    plan = spark.createDataFrame(schedule(cells, shards), "_class long, _cell long, _ends array<long>, _shards array<int>")
    rank = F.row_number().over(Window.partitionBy("_class", "_cell").orderBy("_text")) - 1
    homes = (
        placed.withColumn("_rank", rank)
        .join(plan, ["_class", "_cell"])
        .withColumn("_turn", F.size(F.filter("_ends", lambda end: end <= F.col("_rank"))))
        .select("_text", F.get("_shards", F.col("_turn")).alias("shard"))
    )
    home = durable(rows.join(homes, "_text").select("doc_id", "size", "text_crc32", "shard"), "shard-homes")
    # Rows are numbered in cells of a shard, behind the counts of the cells before.
    many = F.greatest(F.ceil(F.count("*") / cell).cast("long"), F.lit(1)).alias("_parts")
    cut = home.join(F.broadcast(home.groupBy("shard").agg(many)), "shard")
    cut = cut.withColumn("_cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("_parts")))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("shard", "_cell").agg(F.count("*").alias("_n")).select(
        "shard", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    order = Window.partitionBy("shard", "_cell").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    return (
        cut.withColumn("_place", F.row_number().over(order))
        .join(offsets, ["shard", "_cell"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("_offset") + F.col("_place") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
