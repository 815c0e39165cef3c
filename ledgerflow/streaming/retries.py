"""Failure counters as a stream operator: retries come out when their timer fires, counters expire by themselves."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.retry import IDLE_SECONDS, MAX_RETRIES, RETRY_TTL_SECONDS
from .marks import BUCKETS, use_keyed_state

ROUTED = "stream string, event_id string, attempts int, disposition string, at timestamp, payload string"


def route_by_timers(failures: DataFrame, max_retries: int = MAX_RETRIES, base: float = 1.0, cap: float = 30.0,
                    idle_seconds: float = IDLE_SECONDS, ttl_seconds: int = RETRY_TTL_SECONDS, late: str = "1 hour",
                    buckets: int = BUCKETS) -> DataFrame:
    """Retries and dead letters of a stream of failures ``(stream, event_id, failed_at, payload)``, each when it is due.

    A failure adds one to its event's counter, or starts it anew if the last one
    is longer ago than the TTL. Below ``max_retries`` the event comes out as a
    ``retry`` at its next attempt: after its backoff, and not before the idle
    time. That is when the watermark, ``late`` behind the newest failure, has
    passed it, or when the event's next failure at or after it arrives; a failure
    before it puts the attempt off. The last failure comes out as a
    ``dead_letter`` at once and ends the counter. Failures of one micro-batch are
    handled in order of time, so any cut of an ordered feed into batches gives
    the same rows, also across restarts on one checkpoint. State is one counter
    and one payload per failing event, kept with those of its bucket, a hash of
    the event, and cleared by a timer after the TTL; a checkpoint keeps its number of buckets. A
    failure with a NULL time is left out, as are those later than the watermark;
    a NULL event id is one event, a NULL payload stays NULL.
    """
    use_keyed_state(failures.sparkSession)
    ttl, idle = ttl_seconds * 1_000_000, int(idle_seconds * 1_000_000)

    def wait(attempts: int) -> int:
        # As functions.keys.backoff_seconds: the first delay is not capped.
        delay = base if attempts <= 1 else min(base * 2.0 ** min(attempts - 1, 1000), cap)
        return max(int(delay * 1_000_000), idle)

    # Defined here so that workers get it by value.
    class Counter(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            # ``due`` is NULL once the retry is out.
            self.state = handle.getValueState(
                "counters", "streams array<string>, events array<string>, attempts array<int>, last array<long>, due array<long>, payloads array<string>"
            )

        def load(self) -> dict:
            if not self.state.exists():
                return {}
            return {(stream, event): kept for stream, event, *kept in zip(*self.state.get())}

        def store(self, counters: dict, timer: int | None) -> None:
            """Keep the counters of a bucket; its one timer is the earliest that any of them waits for."""
            if counters:
                columns = zip(*[(*who, *kept) for who, kept in counters.items()])
                self.state.update(tuple(list(c) for c in columns))
            else:
                self.state.clear()
            soonest = self.soonest(counters)
            if soonest != timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                if soonest is not None:
                    self.handle.registerTimer(soonest)

        @staticmethod
        def soonest(counters: dict) -> int | None:
            # A retry that is due only after the TTL keeps its counter until it is out.
            return min((fires(last + ttl if due is None else due) for _, last, due, _ in counters.values()), default=None)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            batch = pd.concat(list(rows), ignore_index=True).sort_values("now", kind="stable")
            counters = self.load()
            timer, out = self.soonest(counters), []
            for stream, event, now, text in zip(*[batch[c].tolist() for c in ("stream", "event_id", "now", "payload")]):
                who = (stream if isinstance(stream, str) else None, event if isinstance(event, str) else None)
                attempts, last, due, payload = counters.get(who, (0, None, None, None))
                if due is not None and due <= now:
                    out.append((*who, attempts, "retry", due, payload))
                attempts = attempts + 1 if last is not None and last + ttl >= now else 1
                payload = text if isinstance(text, str) else None
                if attempts >= max_retries:
                    out.append((*who, attempts, "dead_letter", now, payload))
                    counters.pop(who, None)
                else:
                    counters[who] = (attempts, now, now + wait(attempts), payload)
            self.store(counters, timer)
            yield self.rows(out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
            counters, out = {}, []
            for who, (attempts, last, due, payload) in self.load().items():
                if due is not None and fires(due) <= passed:
                    out.append((*who, attempts, "retry", due, payload))
                    due = None
                if due is not None or fires(last + ttl) > passed:
                    counters[who] = (attempts, last, due, payload)
            self.store(counters, None)
            yield self.rows(out)

        @staticmethod
        def rows(out: list[tuple]) -> pd.DataFrame:
            made = pd.DataFrame(out, columns=["stream", "event_id", "attempts", "disposition", "at", "payload"])
            made["at"] = pd.to_datetime(made["at"].astype("int64"), unit="us", utc=True)
            return made

        def close(self) -> None:
            pass

    def fires(micros: int) -> int:
        """The first full millisecond after a time."""
        return micros // 1000 + 1

    narrow = failures.where(F.col("failed_at").isNotNull()).select(
        F.pmod(F.xxhash64(F.col("stream").cast("string"), F.col("event_id").cast("string")), F.lit(buckets)).alias("bucket"),
        F.col("stream").cast("string").alias("stream"), F.col("event_id").cast("string").alias("event_id"),
        F.col("failed_at").cast("timestamp").alias("event_time"), F.unix_micros(F.col("failed_at").cast("timestamp")).alias("now"),
        F.col("payload").cast("string").alias("payload"),
    )
    return narrow.withWatermark("event_time", late).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=Counter(), outputStructType=ROUTED, outputMode="append", timeMode="EventTime"
    )
