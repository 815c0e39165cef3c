"""Repeat suppression within a time-to-live, as joins and as a batch fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import durable
from .groups import split_shared
from .ranking import points_below, split_points

WEEK_SECONDS = 7 * 24 * 3600
# Distinct stamps folded in one array before a key is cut.
STAMPS_PER_RANGE = 1_000_000


def live_marks(ledger: DataFrame, now: Column, ttl_seconds: int = WEEK_SECONDS) -> DataFrame:
    """Ledger rows still in force at ``now``; the last instant of the TTL counts."""
    return ledger.where(F.unix_micros("marked_at") + ttl_seconds * 1_000_000 >= F.unix_micros(now))


def drop_processed(rows: DataFrame, ledger: DataFrame, now: Column, ttl_seconds: int = WEEK_SECONDS) -> DataFrame:
    """Rows whose ``idempotency_key`` has no live mark at ``now``."""
    live = live_marks(ledger, now, ttl_seconds).select("idempotency_key")
    return rows.join(live, "idempotency_key", "left_anti")


def _fold(stamps: Column, start: Column, ttl: int) -> Column:
    """Sequential rule on sorted stamps: keep one that is later than the last kept plus TTL."""
    return F.aggregate(
        stamps,
        F.array(start),
        lambda kept, t: F.when(t > F.element_at(kept, -1) + F.lit(ttl), F.concat(kept, F.array(t))).otherwise(kept),
    )


def _cell(t: Column, width: int) -> Column:
    """Start of the ``width``-wide cell of ``t`` (exact, no division)."""
    return t - F.pmod(t, F.lit(width))


def _walk(stamps: Column, start: Column, ttl: int) -> Column:
    """The rule inside one offset range: on to the next cell only, at a larger offset."""

    def step(kept: Column, t: Column) -> Column:
        last = F.element_at(kept, -1)
        follows = (t > last + F.lit(ttl)) & (_cell(t, ttl) == _cell(last, ttl) + F.lit(ttl))
        return F.when(follows, F.concat(kept, F.array(t))).otherwise(kept)

    return F.aggregate(F.filter(stamps, lambda t: t > start), F.array(start), step)


def kept_stamps(stamps: DataFrame, key: str, ts: str, ttl: int, every: int = STAMPS_PER_RANGE) -> DataFrame:
    """``(key, ts)`` of the instants that survive the TTL rule.

    ``stamps`` holds distinct ``(key, ts)`` with ``ts`` a LONG. A small key is one
    sorted array and one fold. A hot key is cut by the *offset* of its stamps
    within a TTL-wide cell: from a kept stamp the next kept one lies one cell on
    at a larger offset, or else is the earliest stamp after that. So within one
    offset range the rule is walked from the earliest stamp of each cell until
    it leaves the range, and it always enters another range at such an earliest
    stamp. A last fold over these walks, whose number follows the time span and
    not the rows, picks the ones really taken.
    """
    offsets = stamps.select(
        key, F.col(ts).alias("_t"), F.pmod(F.col(ts), F.lit(ttl)).alias("_offset")
    )
    points = durable(split_points(offsets, [key], "_offset", every), "points")
    if points.isEmpty():
        whole = stamps.groupBy(key).agg(F.array_sort(F.collect_list(ts)).alias("_ts"))
        return whole.select(key, F.explode(_fold(F.col("_ts"), F.get("_ts", F.lit(0)), ttl)).alias(ts))
    ranged = offsets.join(points, key, "left").select(
        key, "_t",
        F.when(F.col("_points").isNotNull(), points_below(F.col("_points"), F.col("_offset"))).alias("_range"),
    )
    groups = ranged.groupBy(key, "_range").agg(F.array_sort(F.collect_list("_t")).alias("_ts"))

    small = groups.where(F.col("_range").isNull()).select(
        key, F.explode(_fold(F.col("_ts"), F.get("_ts", F.lit(0)), ttl)).alias(ts)
    )
    entries = F.aggregate(
        F.col("_ts"),
        F.slice("_ts", 1, 1),
        lambda acc, t: F.when(_cell(t, ttl) != _cell(F.element_at(acc, -1), ttl), F.concat(acc, F.array(t))).otherwise(acc),
    )
    walks = (
        groups.where(F.col("_range").isNotNull())
        .select(key, "_ts", F.explode(entries).alias("_entry"))
        .select(key, "_entry", _walk(F.col("_ts"), F.col("_entry"), ttl).alias("_walk"))
    )
    ends = walks.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_entry").alias("entry"), F.element_at("_walk", -1).alias("end")))).alias("_w")
    )
    nothing = F.array().cast("array<bigint>")
    taken = F.aggregate(
        F.col("_w"),
        F.struct(nothing.alias("entries"), F.lit(None).cast("long").alias("last")),
        lambda acc, w: F.when(
            acc["last"].isNull() | (w["entry"] > acc["last"] + F.lit(ttl)),
            F.struct(F.concat(acc["entries"], F.array(w["entry"])).alias("entries"), w["end"].alias("last")),
        ).otherwise(acc),
        lambda acc: acc["entries"],
    )
    chosen = ends.select(key, F.explode(taken).alias("_entry"))
    large = walks.join(chosen, [key, "_entry"], "left_semi").select(key, F.explode("_walk").alias(ts))
    return small.unionByName(large)


def first_seen(rows: DataFrame, key: str, now: str, order: str, ttl_seconds: int = WEEK_SECONDS,
               prior: DataFrame | None = None, every: int = STAMPS_PER_RANGE) -> DataFrame:
    """Marks ``(key, mark, order)`` set by rows processed in ``(now, order)`` sequence.

    A row sets a mark when no earlier mark of its key is at most ``ttl_seconds``
    old; a suppressed row does not prolong the mark. ``now`` and ``mark`` are
    microseconds. ``prior`` holds ``(key, mark)`` set before: those come back
    with a NULL ``order``.
    """
    ttl = ttl_seconds * 1_000_000
    stamped = rows.select(key, F.col(now).alias("mark"), order, F.lit(False).alias("_prior"))
    if prior is not None:
        nobody = F.lit(None).cast(rows.schema[order].dataType).alias(order)
        stamped = stamped.unionByName(prior.select(key, "mark", nobody, F.lit(True).alias("_prior")))
    firsts = durable(stamped.groupBy(key, "mark").agg(
        F.when(~F.max("_prior"), F.min(order)).alias(order)
    ), "firsts")
    kept = kept_stamps(firsts.select(key, "mark"), key, "mark", ttl, every)
    return firsts.join(kept, [key, "mark"], "left_semi")


def mark_repeats(rows: DataFrame, marks: DataFrame, key: str, now: str, order: str, ttl_seconds: int = WEEK_SECONDS) -> DataFrame:
    """Add ``repeat``: an earlier live mark of the key covers the row.

    Marks of a key are more than a TTL apart, so a row meets at most one. Each
    mark is listed under the two TTL-wide cells it reaches and rows are matched
    on (key, cell), which spreads a hot key over its time span.
    """
    ttl = ttl_seconds * 1_000_000
    width = ttl + 1
    listed = marks.select(
        key, F.col("mark").alias("_mark"), F.col(order).alias("_by"),
        F.explode(F.array(_cell(F.col("mark"), width), _cell(F.col("mark"), width) + width)).alias("_cell"),
    )
    timed = rows.withColumn("_cell", _cell(F.col(now), width))
    at, mark, by, mine = F.col(f"r.{now}"), F.col("m._mark"), F.col("m._by"), F.col(f"r.{order}")
    covers = (
        (F.col(f"r.{key}") == F.col(f"m.{key}"))
        & (F.col("r._cell") == F.col("m._cell"))
        & (at >= mark)
        & (at <= mark + F.lit(ttl))
        & (by.isNull() | (at > mark) | (mine > by))
    )
    joined = timed.alias("r").join(listed.alias("m"), covers, "left")
    return joined.select(*[F.col(f"r.{c}") for c in rows.columns], F.col("m._mark").isNotNull().alias("repeat"))


def settle(rows: DataFrame, ledger: DataFrame | None, ttl_seconds: int = WEEK_SECONDS, every: int = STAMPS_PER_RANGE) -> DataFrame:
    """Add ``repeat`` to a batch of rows, against the ledger and within the batch.

    ``rows``: idempotency_key, arrived_at, ord, valid. Only valid rows set marks,
    so a failing row never claims its key, but a failing row under a live mark is
    a repeat. A row that arrived before the ledger's mark is handled after it.
    The one row of a key without a mark is no repeat; only the others are
    compared. ``rows`` are a table that is cheap to read again.
    """
    key = "idempotency_key"
    prior = None if ledger is None else ledger.groupBy(key).agg(F.unix_micros(F.max("marked_at")).alias("mark"))
    alone, rest = split_shared(rows, [key], None if prior is None else prior.select(key))
    timed = durable(rest, "rest").withColumn("_now", F.unix_micros("arrived_at"))
    if prior is not None:
        late = prior.select(key, F.col("mark").alias("_prior_mark"))
        timed = (
            timed.join(late, key, "left")
            .withColumn("_now", F.greatest("_now", "_prior_mark"))
            .drop("_prior_mark")
        )
    marks = first_seen(timed.where("valid"), key, "_now", "ord", ttl_seconds, prior, every)
    judged = mark_repeats(timed, marks, key, "_now", "ord", ttl_seconds).drop("_now")
    return alone.withColumn("repeat", F.lit(False)).unionByName(judged)
