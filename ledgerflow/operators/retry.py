"""Failure counting, backoff and the dead-letter route."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import keys as K
from ..functions.jsontext import sorted_json

RETRY_TTL_SECONDS = 2 * 24 * 3600
MAX_RETRIES = 5
IDLE_SECONDS = 60.0


def count_failures(failed: DataFrame, attempts: DataFrame | None = None, now: Column | None = None,
                   ttl_seconds: int = RETRY_TTL_SECONDS) -> DataFrame:
    """``(stream, event_id, attempts, last_failed_at)`` after the failures in ``failed``.

    ``failed``: stream, event_id, failed_at; one row per failure. Stored counters
    older than the TTL (at the first new failure, or at ``now``) count as zero.
    """
    fresh = failed.groupBy("stream", "event_id").agg(
        F.count(F.lit(1)).cast("int").alias("_new"),
        F.min("failed_at").alias("_first"), F.max("failed_at").alias("last_failed_at"),
    )
    if attempts is None:
        return fresh.select("stream", "event_id", F.col("_new").alias("attempts"), "last_failed_at")
    stored = attempts.select("stream", "event_id", F.col("attempts").alias("_old"), F.col("last_failed_at").alias("_at"))
    at = F.col("_first") if now is None else now
    live = F.unix_micros("_at") + ttl_seconds * 1_000_000 >= F.unix_micros(at)
    old = F.when(live, F.col("_old")).otherwise(0)
    return fresh.join(stored, ["stream", "event_id"], "left").select(
        "stream", "event_id", (F.coalesce(old, F.lit(0)) + F.col("_new")).cast("int").alias("attempts"), "last_failed_at"
    )


def route_failures(counted: DataFrame, max_retries: int = MAX_RETRIES, base: float = 1.0, cap: float = 30.0,
                   idle_seconds: float = IDLE_SECONDS) -> DataFrame:
    """Add ``disposition`` (retry or dead_letter), ``backoff_seconds`` and ``next_attempt_at``.

    A retry is due after its backoff, and not before the redelivery idle time.
    """
    dead = F.col("attempts") >= max_retries
    backoff = K.backoff_seconds(F.col("attempts"), base, cap)
    wait_micros = (F.greatest(backoff, F.lit(float(idle_seconds))) * 1_000_000).cast("long")
    due = F.timestamp_micros(F.unix_micros("last_failed_at") + wait_micros)
    return counted.select(
        "*",
        F.when(dead, "dead_letter").otherwise("retry").alias("disposition"),
        F.when(~dead, backoff).alias("backoff_seconds"),
        F.when(~dead, due).alias("next_attempt_at"),
    )


def due_retries(attempts: DataFrame, now: Column, limit: int | None = None, order: Column | str = "event_id") -> DataFrame:
    """Retries whose time has come, first in ``order`` first (feeds give the order of arrival), at most ``limit`` of them."""
    due = attempts.where(F.col("next_attempt_at") <= now)
    return due if limit is None else due.orderBy(order).limit(limit)


def dead_letters(dead: DataFrame, payload: Mapping[str, Column], raw: tuple[str, ...] = ()) -> DataFrame:
    """Dead-letter rows, all text.

    ``dead``: stream, event_id, attempts, error, trace_id, last_failed_at. The
    payload is JSON with sorted keys; members named in ``raw`` are JSON already.
    """
    return dead.select(
        F.col("stream").alias("source_stream"),
        F.col("event_id").cast("string").alias("original_event_id"),
        F.col("attempts").cast("string").alias("attempts"),
        "error",
        F.coalesce("trace_id", F.lit("")).alias("trace_id"),
        sorted_json(payload, raw).alias("payload"),
        K.iso_timestamp(F.col("last_failed_at")).alias("failed_at"),
    )
