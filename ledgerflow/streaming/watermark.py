"""Repeat suppression inside a streaming query's own state."""

from __future__ import annotations

from pyspark.sql import DataFrame


def first_within(stream: DataFrame, key: str = "idempotency_key", at: str = "arrived_at", delay: str = "7 days") -> DataFrame:
    """Keep the first row of a key until the watermark has moved ``delay`` past it.

    Cheaper than the ledger, but a row is marked when seen and not when it
    succeeded, and expiry follows event time; the feeds use the ledger.
    """
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])
