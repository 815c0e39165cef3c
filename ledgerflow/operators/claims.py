"""Who may hold a unique value: ordered, first-come claims over several keys.

Rows arrive in ``order``. A row for ``key`` is accepted when none of its claim
values is held by *another* key at that moment; accepting it makes the key hold
exactly the row's values, releasing the ones it held before. A rejected row
changes nothing. Order values must be unique among the incoming rows.

With marks, a row may also be a repeat (its mark was set at most a TTL ago) or
invalid; neither claims anything, and only an accepted row sets its mark.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import durable
from .groups import connected


def first_claims(incoming: DataFrame, existing: DataFrame | None, key: str, claim: str, order: str) -> DataFrame:
    """Verdicts when every key always brings the same claim value.

    Then nothing is ever released and the first key to bring a value owns it:
    one aggregation with map-side combine and one join against the values that
    more than one key brought. ``incoming`` plus ``accepted`` and ``holder``.
    """
    rank = F.struct(F.lit(1).alias("gen"), F.col(order).alias("ord"))
    rows = incoming.select(key, claim, rank.alias("_rank"))
    if existing is not None:
        order_type = incoming.schema[order].dataType
        stored = F.struct(F.lit(0).alias("gen"), F.lit(None).cast(order_type).alias("ord"))
        rows = existing.select(key, claim, stored.alias("_rank")).unionByName(rows)
    contended = (
        rows.where(F.col(claim).isNotNull())
        .groupBy(claim)
        .agg(F.min_by(key, "_rank").alias("holder"), F.min(key).alias("_lo"), F.max(key).alias("_hi"))
        .where(F.col("_lo") != F.col("_hi"))
        .select(claim, "holder")
    )
    accepted = F.col("holder").isNull() | (F.col("holder") == F.col(key))
    return incoming.join(contended, claim, "left").select(
        *[F.col(c) for c in incoming.columns], accepted.alias("accepted"), "holder"
    )


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def sort_keys(rows: DataFrame, stored: DataFrame, key: str, claims: Sequence[str], order: str, mark: str | None) -> DataFrame:
    """One row per key: ``fate`` is ``free``, ``lost`` or NULL for what must be scanned in order.

    ``rows``: key, claims, order, ``_valid``, ``_marked`` (the mark is set already).
    A key is *steady* when all its valid rows, and what it holds, agree. A value's
    *owner* is the key that holds it, else the key of its earliest valid row. A
    steady key that owns all its values gets them with its first valid row and
    never lets go: it is free. A steady key with a value of a free key is
    refused whenever it comes: it is lost. With marks both must be the only users
    of their mark, which must not be set already. Values are aggregated with
    map-side combine, so a hot value costs one row per task.
    """
    sign = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in claims], *[F.col(c).isNull().alias(f"{c}_null") for c in claims])
    stored = stored.select(key, *claims)
    seen = rows.where("_valid").select(key, *claims, F.struct(F.lit(1).alias("gen"), F.col(order).alias("ord")).alias("_rank"))
    nobody = F.struct(F.lit(0).alias("gen"), F.lit(None).cast(rows.schema[order].dataType).alias("ord"))
    touched = seen.unionByName(stored.withColumn("_rank", nobody))
    steady = touched.groupBy(key).agg(
        (F.min(sign) == F.max(sign)).alias("_steady"), F.min("_rank.gen").alias("_gen"), *[F.min(c).alias(c) for c in claims]
    )
    marked = rows.groupBy(key).agg(F.max("_marked").alias("_marked"))
    facts = steady.join(marked, key, "full")
    steady_now, marked_now, holds = F.coalesce("_steady", F.lit(True)), F.coalesce("_marked", F.lit(False)), F.coalesce(F.col("_gen") == 0, F.lit(False))
    # A mark that is set matters only to a key that does not hold its values yet.
    quiet = steady_now & (~marked_now | holds)
    if mark is not None:
        # Marks are used by rows of any kind, valid or not.
        used = rows.select(key, F.col(mark).alias("_m")).groupBy("_m").agg(F.min(key).alias("_lo"), F.max(key).alias("_hi")).where("_lo <> _hi").select("_m")
        shared = rows.select(key, F.col(mark).alias("_m")).join(used, "_m", "left_semi").select(key).distinct()
        facts = facts.join(shared.withColumn("_shared", F.lit(True)), key, "left")
        quiet = quiet & F.col("_shared").isNull()
    facts = facts.withColumn("_quiet", quiet)
    owners = []
    for claim in claims:
        # Only values that more than one key brings need an owner.
        owner = (
            touched.where(F.col(claim).isNotNull()).groupBy(claim)
            .agg(F.min_by(key, "_rank").alias(f"_owner_{claim}"), F.min(key).alias("_lo"), F.max(key).alias("_hi"))
            .where("_lo <> _hi").select(claim, f"_owner_{claim}")
        )
        owners.append(owner)
        facts = facts.join(owner, claim, "left")
    owns = _all([F.coalesce(F.col(f"_owner_{c}") == F.col(key), F.lit(True)) for c in claims])
    facts = durable(facts.withColumn("_free", F.col("_quiet") & owns), "keys")
    taken = [
        facts.where(F.col("_free") & F.col(f"_owner_{c}").isNotNull()).select(F.col(key).alias(f"_owner_{c}"), F.lit(True).alias(f"_kept_{c}"))
        for c in claims
    ]
    for claim, kept in zip(claims, taken):
        facts = facts.join(kept, f"_owner_{claim}", "left")
    lost = F.col("_quiet") & _any([F.coalesce(F.col(f"_kept_{c}"), F.lit(False)) & (F.col(f"_owner_{c}") != F.col(key)) for c in claims])
    return facts.select(key, F.when(F.col("_free"), "free").when(lost, "lost").alias("fate"))


def _owned(rows: DataFrame, fates: DataFrame, all_rows: DataFrame, stored: DataFrame, key: str, claims: Sequence[str]) -> DataFrame:
    """``rows`` with ``_blocked``: a claim value belongs to a free key, which came before every other that brings it."""
    free = fates.where("fate = 'free'").select(key)
    held = all_rows.where("_valid").select(key, *claims).unionByName(stored.select(key, *claims)).join(free, key, "left_semi")
    blocked = F.lit(False)
    for claim in claims:
        mine = held.where(F.col(claim).isNotNull()).select(claim, F.lit(True).alias(f"_taken_{claim}")).distinct()
        rows = rows.join(mine, claim, "left")
        blocked = blocked | F.coalesce(F.col(f"_taken_{claim}"), F.lit(False))
    return rows.withColumn("_blocked", blocked).drop(*[f"_taken_{c}" for c in claims])


def _scan(rows: DataFrame, key: str, claims: Sequence[str], order: str, ttl: int) -> DataFrame:
    """Walk each group in order: what is held already first, then the rows; adds ``accepted`` and ``repeat``.

    Groups are sorted and streamed, not gathered: a task holds one batch of rows
    and the values and marks that are held in the group it is in.
    """
    width = len(claims)
    columns = [f"_c{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, holder, marks = None, {}, [], {}
        for batch in batches:
            lists = {n: batch.column(n).to_pylist() for n in ("_group", "_gen", "_key", *columns, "_valid", "_blocked", "_mark", "_now", "_prior")}
            accepted, repeat = [], []
            for at, now_in in enumerate(lists["_group"]):
                if now_in != group:
                    group, held, holder, marks = now_in, {}, [{} for _ in claims], {}
                who, values = lists["_key"][at], [lists[c][at] for c in columns]
                if lists["_gen"][at] == 0:
                    verdict, again = True, False
                else:
                    mark, now, prior = lists["_mark"][at], lists["_now"][at], lists["_prior"][at]
                    last = max((t for t in (marks.get(mark), prior) if t is not None), default=None) if mark is not None else None
                    # A row that arrived before the mark is handled after it.
                    now = now if last is None or now is None else max(now, last)
                    again = last is not None and last + ttl >= now
                    verdict = not again and lists["_valid"][at] and not lists["_blocked"][at] and all(
                        v is None or holder[i].get(v, who) == who for i, v in enumerate(values)
                    )
                if verdict:
                    for i, old in enumerate(held.get(who, ())):
                        if old is not None:
                            holder[i].pop(old, None)
                    held[who] = values
                    for i, v in enumerate(values):
                        if v is not None:
                            holder[i][v] = who
                    if lists["_gen"][at] and mark is not None:
                        marks[mark] = now
                accepted.append(verdict)
                repeat.append(again)
            keep = pa.array([g == 1 for g in lists["_gen"]])
            done = pa.RecordBatch.from_arrays([batch.column("_ord"), pa.array(accepted), pa.array(repeat)], ["_ord", "accepted", "repeat"])
            yield done.filter(keep)

    ready = rows.repartition("_group").sortWithinPartitions("_group", "_gen", "_ord")
    order_type = rows.schema["_ord"].dataType.simpleString()
    found = ready.mapInArrow(run, f"_ord {order_type}, accepted boolean, repeat boolean")
    return found.withColumnRenamed("_ord", order)


def scan_claims(rows: DataFrame, fates: DataFrame, stored: DataFrame, everything: DataFrame, key: str, claims: Sequence[str], order: str, ttl: int) -> DataFrame:
    """``(order, accepted, repeat)`` of the rows that must be decided one after the other.

    Keys that share a value or a mark form a group, found in rounds that are
    logarithmic in its size; a group is walked once, in order. Keys whose fate
    is settled take no part, but a value of a free key is out of reach.
    """
    rows = durable(_owned(rows, fates, everything, stored, key, claims), "contended")
    keys = rows.select(key).distinct()
    mine = stored.join(keys, key, "left_semi").select(key, *claims)
    links = []
    for claim in claims:
        # Rows, not what is held: a held value nobody brings links nothing.
        both = rows.where("NOT _blocked").select(key, F.col(claim).cast("string").alias("_v")).unionByName(mine.select(key, F.col(claim).cast("string").alias("_v")))
        links.append(both.where("_v IS NOT NULL").distinct().withColumn("_kind", F.lit(claim)))
    links.append(rows.where("_mark IS NOT NULL").select(key, F.col("_mark").alias("_v"), F.lit("mark").alias("_kind")).distinct())
    shared = reduce(DataFrame.unionByName, links)
    least = shared.groupBy("_kind", "_v").agg(F.min(key).alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = shared.join(least, ["_kind", "_v"]).select(F.col(key).alias("a"), "b").where("a <> b").distinct()
    groups = connected(edges).select(F.col("id").alias(key), F.col("component").alias("_group"))
    names = [F.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(claims)]
    walked = rows.select(F.lit(1).alias("_gen"), F.col(key), F.col(order).alias("_ord"), *names, "_valid", "_blocked", "_mark", "_now", "_prior")
    none = F.lit(None)
    before = mine.select(
        F.lit(0).alias("_gen"), F.col(key), none.cast(rows.schema[order].dataType).alias("_ord"), *names, F.lit(True).alias("_valid"), F.lit(False).alias("_blocked"),
        none.cast("string").alias("_mark"), none.cast("long").alias("_now"), none.cast("long").alias("_prior"),
    )
    both = walked.unionByName(before).join(groups, key, "left").withColumn("_group", F.coalesce("_group", key)).withColumn("_key", F.col(key).cast("string")).drop(key)
    return _scan(both, key, claims, order, ttl)


def resolve_claims(incoming: DataFrame, existing: DataFrame | None, key: str, claims: Sequence[str], order: str) -> DataFrame:
    """Exact ordered verdicts, also when keys change their values: ``(key, claims, order, accepted)``.

    Steady keys are decided by aggregations (``sort_keys``); what is left, keys
    that change while they share a value, is walked in order within groups of
    such keys (``scan_claims``).
    """
    claims = list(claims)
    rows = durable(incoming.select(key, *claims, order).withColumns({
        "_valid": F.lit(True), "_marked": F.lit(False), "_mark": F.lit(None).cast("string"), "_now": F.lit(None).cast("long"), "_prior": F.lit(None).cast("long"),
    }), "claims")
    stored = rows.select(key, *claims).limit(0) if existing is None else durable(existing.select(key, *claims), "held")
    fates = durable(sort_keys(rows, stored, key, claims, order, None), "fates")
    columns = [key, *claims, order]
    easy = rows.join(fates.where("fate IS NOT NULL"), key).select(*columns, (F.col("fate") == "free").alias("accepted"))
    open_ = fates.where("fate IS NULL").select(key)
    if open_.isEmpty():
        return easy
    hard = rows.join(open_, key, "left_semi")
    done = durable(scan_claims(hard, fates, stored, rows, key, claims, order, 0).drop("repeat"), "scanned")
    return easy.unionByName(hard.select(*columns).join(done, order))
