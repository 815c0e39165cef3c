"""The repeat rule as a stream operator: one mark per key in keyed state, cleared by event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.dedup import WEEK_SECONDS

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark: SparkSession) -> None:
    """Keep stream state on disk beside the executors and in the checkpoint, as keyed state and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


# Keys are kept in so many groups of stream state: a call to the state costs far more than a row.
BUCKETS = 1024


def flag_repeats(rows: DataFrame, key: str, at: str, order: str, ttl_seconds: int = WEEK_SECONDS, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """``(key, at, order, repeat)`` of a stream's rows, as ``operators.dedup.first_seen`` has it for a table.

    A row sets its key's mark unless an earlier mark is at most the TTL old; then
    it is a repeat and does not prolong the mark. Rows of one micro-batch are
    handled in ``(at, order)`` sequence, so any cut of an ordered feed into
    batches gives the same marks, also across restarts on one checkpoint. The
    state is one timestamp per key, kept with those of its bucket, a hash of the
    key; a checkpoint keeps its number of buckets. A timer clears it when the watermark, ``late``
    behind the newest row, has passed the end of its TTL: no row that is still
    let in could be its repeat. Rows later than that are dropped, as by any
    watermark. A task holds the rows of one bucket of one micro-batch, whose size
    the source caps, and the bucket's marks. A row with a NULL key belongs to the key NULL; one
    with a NULL time is no event and left out.
    """
    ttl = ttl_seconds * 1_000_000
    use_keyed_state(rows.sparkSession)

    # Defined here so that workers get it by value.
    class Marks(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("marks", "names array<string>, marks array<long>")

        def load(self) -> dict:
            return dict(zip(*self.state.get())) if self.state.exists() else {}

        def store(self, marks: dict, timer: int | None) -> None:
            """Keep the marks of a bucket; its one timer is that of the earliest."""
            soonest = self.ends(min(marks.values())) if marks else None
            if marks:
                self.state.update((list(marks), list(marks.values())))
            else:
                self.state.clear()
            if soonest != timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                if soonest is not None:
                    self.handle.registerTimer(soonest)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            batch = pd.concat(list(rows), ignore_index=True).sort_values(["now", "ord"], kind="stable", ignore_index=True)
            marks = self.load()
            timer = self.ends(min(marks.values())) if marks else None
            flags = []
            for name, now in zip(batch["name"].tolist(), batch["now"].tolist()):
                name = name if isinstance(name, str) else None
                mark = marks.get(name)
                # A row that arrived before the mark is handled after it.
                repeat = mark is not None and max(now, mark) <= mark + ttl
                flags.append(repeat)
                if not repeat:
                    marks[name] = now
            self.store(marks, timer)
            yield pd.DataFrame({"key": batch["key"], "now": batch["now"], "ord": batch["ord"], "repeat": flags})

        @staticmethod
        def ends(mark: int) -> int:
            """The first full millisecond after the TTL of a mark."""
            return (mark + ttl) // 1000 + 1

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
            self.store({name: mark for name, mark in self.load().items() if self.ends(mark) > passed}, None)
            yield from ()

        def close(self) -> None:
            pass

    types = {c: rows.schema[c].dataType.simpleString() for c in (key, order)}
    narrow = rows.where(F.col(at).isNotNull()).select(
        F.col(at).cast("timestamp").alias("event_time"), F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), F.col(key).cast("string").alias("name"),
        F.col(key).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("now"), F.col(order).alias("ord"),
    )
    flagged = narrow.withWatermark("event_time", late).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=Marks(), outputStructType=f"key {types[key]}, now long, ord {types[order]}, repeat boolean", outputMode="append", timeMode="EventTime",
    )
    return flagged.select(F.col("key").alias(key), F.timestamp_micros("now").alias(at), F.col("ord").alias(order), "repeat")
