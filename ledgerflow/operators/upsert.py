"""Merges of incoming rows into the four tables.

Every operator takes the stored rows (``None`` for an empty table) and incoming
rows in arrival ``ord``, and returns DataFrames; nothing is written. With
``touched_only`` just the inserted and updated rows come back, for a caller that
appends changes instead of rewriting a table.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schema
from ..functions import keys as K
from ..session import durable
from .claims import first_claims, resolve_claims
from .groups import split_shared
from .ranking import SPLIT_EVERY, grouped_rank, surrogate_ids

ORDER = "ord"


class Merge(NamedTuple):
    """Merged table rows, incoming rows a unique key refused, and all verdicts."""

    rows: DataFrame
    rejected: DataFrame
    verdicts: DataFrame


def empty(spark: SparkSession, table: schema.Table) -> DataFrame:
    """No rows; the constant filter lets the optimizer drop joins with it."""
    return spark.createDataFrame([], table.struct).where(F.lit(False))


def _stored(existing: DataFrame | None, spark: SparkSession, table: schema.Table) -> DataFrame:
    return empty(spark, table) if existing is None else existing.select(*table.struct.names)


def last_non_null(column: str, order: str = ORDER) -> Column:
    """The latest value that is not NULL."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order)))


def last_value(columns: Sequence[str], order: str = ORDER) -> Column:
    """The latest row's values as a struct, NULLs included."""
    return F.max_by(F.struct(*columns), order)


def last_rows(df: DataFrame, key: str, order: str = ORDER) -> DataFrame:
    """The last row of each key.

    The one row of a key is its last, and stays where it is. Of repeated keys the
    order value is aggregated first (narrow, combined map-side) and wide rows are
    joined on ``(key, order)``, so texts are neither aggregated nor gathered per
    key and a hot key spreads over the order values. ``df`` is a table that is
    cheap to read again.
    """
    alone, rest = split_shared(df, [key])
    last = rest.groupBy(key).agg(F.max(order).alias(order))
    alone = alone.where(F.col(key).isNotNull() & F.col(order).isNotNull())
    # An inner join on unique keys: a semi join would be pushed below the filter that made the rest few.
    return alone.unionByName(rest.join(last, [key, order]).select(*df.columns))


def next_sequence(existing_messages: DataFrame, group: str = "conversation_id") -> DataFrame:
    """``(group, base)``: the largest stored sequence number."""
    return existing_messages.groupBy(group).agg(
        F.coalesce(F.max("seq"), F.lit(0)).cast("long").alias("base")
    )


def _staged(df: DataFrame, staged: bool, name: str) -> DataFrame:
    """The narrow columns a merge is planned on, written once unless they come from a table."""
    return df if staged else durable(df, name)


def _with_ids(updates: DataFrame, key: str, stored: DataFrame, taken: DataFrame | None, every: int) -> DataFrame:
    """Add ``new_id``, dense in first-arrival order, to updates of keys not stored yet."""
    updates = durable(updates, "updates")
    known = stored.select(key)
    ids = surrogate_ids(updates.join(known, key, "left_anti"), "first_ord", "new_id", stored.select("id") if taken is None else taken, every)
    old = updates.join(known, key, "left_semi")
    return ids.unionByName(old.withColumn("new_id", F.lit(None).cast("long")))


def _merge(table: schema.Table, existing: DataFrame, updates: DataFrame, sticky: Sequence[str], touched_only: bool) -> DataFrame:
    """Outer-join stored and updated rows on the natural key.

    ``updates`` has one row per key with the table's payload, the first arrival
    time ``first_at``, the last ``at`` and ``new_id``. ``sticky`` columns keep
    the stored value.
    """
    key = table.key
    kept = {"id", "created_at", *sticky}
    names = table.struct.names
    e = existing.select(F.col(key), F.struct(*[F.col(c) for c in names if c != key]).alias("e"))
    u = updates.withColumnsRenamed({"new_id": "id", "first_at": "created_at", "at": "updated_at"})
    u = u.select(F.col(key), F.struct(*[F.col(c) for c in names if c != key]).alias("u"))
    both = e.join(u, key, "right" if touched_only else "full")
    columns = [F.col(key)]
    for name in names:
        if name == key:
            continue
        fresh = F.col(f"u.{name}")
        if name in ("created_at", "updated_at"):
            fresh = F.date_trunc("SECOND", fresh)
        stays = F.col("e").isNotNull() if name in kept else F.col("u").isNull()
        columns.append(F.when(stays, F.col(f"e.{name}")).otherwise(fresh).alias(name))
    return both.select(*columns).select(*[F.col(n).cast(t).alias(n) for n, t, _, _ in table.columns])


def upsert_conversations(existing: DataFrame | None, incoming: DataFrame, *, touched_only: bool = False, staged: bool = False,
                         taken: DataFrame | None = None, every: int = SPLIT_EVERY) -> DataFrame:
    """Conversations by ``session_id``; a NULL user or title keeps the stored one.

    ``incoming``: session_id, user_id, title, ord, at.
    """
    table = schema.CONVERSATIONS
    stored = _stored(existing, incoming.sparkSession, table)
    rows = _staged(incoming.select("session_id", "user_id", "title", ORDER, "at"), staged, "sessions")
    updates = rows.groupBy("session_id").agg(
        last_non_null("user_id").alias("user_id"),
        last_non_null("title").alias("title"),
        F.min(ORDER).alias("first_ord"),
        F.min_by("at", ORDER).alias("first_at"),
        F.max_by("at", ORDER).alias("at"),
    )
    old = stored.select("session_id", F.col("user_id").alias("_user"), F.col("title").alias("_title"))
    updates = (
        updates.join(old, "session_id", "left")
        .withColumn("user_id", F.coalesce("user_id", "_user"))
        .withColumn("title", F.coalesce("title", "_title"))
    )
    return _merge(table, stored, _with_ids(updates, "session_id", stored, taken, every), (), touched_only)


def conversation_ids(incoming: DataFrame, conversations: DataFrame) -> DataFrame:
    """Add ``conversation_id`` to rows that carry a ``session_id``."""
    ids = conversations.select("session_id", F.col("id").alias("conversation_id"))
    return incoming.join(ids, "session_id", "inner")


def assign_sequences(existing: DataFrame, incoming: DataFrame, group: str = "conversation_id", every: int = SPLIT_EVERY) -> DataFrame:
    """``(message_id, group, seq, first_ord, first_at, last_ord)`` of each incoming message.

    A message belongs to the conversation that first brought it. Messages new to
    the table are numbered after the largest stored number, in first-arrival
    order; a repeated message burns no number (``seq`` stays NULL for stored ones).
    """
    alone, rest = split_shared(incoming, ["message_id"])
    single = alone.select("message_id", group, F.col(ORDER).alias("first_ord"), F.col("at").alias("first_at"), F.col(ORDER).alias("last_ord"))
    bound = durable(single.unionByName(rest.groupBy("message_id").agg(
        F.min_by(group, ORDER).alias(group), F.min(ORDER).alias("first_ord"),
        F.min_by("at", ORDER).alias("first_at"), F.max(ORDER).alias("last_ord"),
    )), "bound")
    known = existing.select("message_id")
    fresh = bound.join(known, "message_id", "left_anti")
    ranked = grouped_rank(fresh, [group], "first_ord", "_rank", every)
    numbered = ranked.join(next_sequence(existing, group), group, "left").withColumn(
        "seq", (F.coalesce(F.col("base"), F.lit(0)) + F.col("_rank")).cast("int")
    )
    repeated = bound.join(known, "message_id", "left_semi").withColumn("seq", F.lit(None).cast("int"))
    columns = ["message_id", group, "seq", "first_ord", "first_at", "last_ord"]
    return numbered.select(*columns).unionByName(repeated.select(*columns))


def upsert_messages(existing: DataFrame | None, incoming: DataFrame, *, touched_only: bool = False, staged: bool = False,
                    taken: DataFrame | None = None, bases: DataFrame | None = None, every: int = SPLIT_EVERY) -> DataFrame:
    """Messages by ``message_id``; conversation and sequence stay, the rest is overwritten.

    ``incoming``: conversation_id, message_id, role, text, trace_id,
    idempotency_key, metadata, ord, at. ``bases`` may name rows
    ``(message_id, conversation_id, seq)`` to continue numbering from when
    ``existing`` holds only the rows that are touched.
    """
    table = schema.MESSAGES
    stored = _stored(existing, incoming.sparkSession, table)
    known = stored.select("message_id", "conversation_id", "seq") if bases is None else bases
    narrow = _staged(incoming.select("message_id", "conversation_id", ORDER, "at"), staged, "arrivals")
    bound = _with_ids(assign_sequences(known, narrow, every=every), "message_id", stored, taken, every)
    payload = incoming.drop("conversation_id").withColumnRenamed(ORDER, "last_ord")
    updates = payload.join(bound, ["message_id", "last_ord"], "inner")
    return _merge(table, stored, updates, ("conversation_id", "seq"), touched_only)


def record_turns(turns: DataFrame) -> DataFrame:
    """Explode turns to message rows: the user's, then the assistant's.

    ``turns``: session_id, user_text, assistant_text, user_message_id,
    assistant_message_id, trace_id, idempotency_key, user_metadata,
    assistant_metadata, ord, at, and optionally event_id. A missing message id
    gets one made from the session, key, event and role: the same event gives the
    same messages again, another event gives new ones.
    """
    event = [F.col("event_id")] if "event_id" in turns.columns else []

    def side(role: str, place: int) -> Column:
        given = F.nullif(F.col(f"{role}_message_id"), F.lit(""))
        made = K.generated_message_id(F.col("session_id"), F.coalesce("idempotency_key", F.lit("")), *event, F.lit(role))
        return F.struct(
            F.lit(role).alias("role"), F.coalesce(given, made).alias("message_id"),
            F.col(f"{role}_text").alias("text"), F.col(f"{role}_metadata").alias("metadata"),
            F.struct(F.col(ORDER).alias("turn"), F.lit(place).alias("place")).alias(ORDER),
        )

    exploded = turns.select(
        "session_id", "trace_id", "idempotency_key", "at",
        F.explode(F.array(side("user", 0), side("assistant", 1))).alias("m"),
    )
    return exploded.select("session_id", "trace_id", "idempotency_key", "at", "m.*")


def document_verdicts(existing: DataFrame | None, incoming: DataFrame, bound: bool) -> DataFrame:
    """``(document_key, content_hash, idempotency_key, ord, accepted)``, without the texts."""
    columns = ["document_key", "content_hash", "idempotency_key"]
    narrow = incoming.select(*columns, ORDER)
    stored = None if existing is None else existing.select(*columns)
    if bound:
        return first_claims(narrow, stored, "document_key", "content_hash", ORDER).drop("holder")
    return resolve_claims(narrow, stored, "document_key", ["content_hash", "idempotency_key"], ORDER)


def _accepted(narrow: DataFrame, verdicts: DataFrame, key: str, first: Sequence[str] = ()) -> DataFrame:
    """Per key: first and last accepted arrival, and ``first`` columns of the first."""
    ok = verdicts.where("accepted").select(key, ORDER).join(narrow.select(key, ORDER, "at", *first), [key, ORDER], "inner")
    return _arrivals(ok, key, first)


def _arrivals(ok: DataFrame, key: str, first: Sequence[str] = ()) -> DataFrame:
    """Per key: first and last arrival, and ``first`` columns of the first."""
    return ok.groupBy(key).agg(
        F.min(ORDER).alias("first_ord"), F.min_by("at", ORDER).alias("first_at"), F.max(ORDER).alias(ORDER),
        *[F.min_by(c, ORDER).alias(c) for c in first],
    )


def _all_arrivals(rows: DataFrame, key: str, first: Sequence[str] = ()) -> DataFrame:
    """The same for a table of accepted rows; a key's only row is left where it is."""
    alone, rest = split_shared(rows.select(key, ORDER, "at", *first), [key])
    single = alone.select(key, F.col(ORDER).alias("first_ord"), F.col("at").alias("first_at"), ORDER, *first)
    return single.unionByName(_arrivals(rest, key, first))


def _rejected(verdicts: DataFrame, key: str, what: str) -> DataFrame:
    refused = verdicts.where(~F.col("accepted")).select(key, ORDER)
    return refused.withColumn("error", F.concat(F.lit(f"Failed to persist {what} "), F.col(key)))


def upsert_documents(existing: DataFrame | None, incoming: DataFrame, *, bound: bool = False, settled: bool = False,
                     touched_only: bool = False, staged: bool = False, taken: DataFrame | None = None,
                     claimed: DataFrame | None = None, every: int = SPLIT_EVERY) -> Merge:
    """Documents by ``document_key``, everything overwritten.

    A row whose content or idempotency key another document holds is rejected.
    ``incoming``: document_key, content, source, title_path, trace_id,
    idempotency_key, metadata, ord, at. Claims and ids are worked out on the
    narrow columns, which are written once; texts are joined to the outcome.

    ``bound`` promises that content is fixed by the key and idempotency keys are
    NULL or derived from it, which settles all claims in one aggregation;
    otherwise they are resolved in order (see ``claims``). ``settled`` promises that no row can
    be refused. ``claimed`` may hold the current ``(document_key, content_hash,
    idempotency_key)`` rows when ``existing`` is limited to touched keys.
    ``staged`` says that ``incoming`` is a table and cheap to read again.
    """
    table, key = schema.DOCUMENTS, "document_key"
    rows = incoming.withColumn("content_hash", K.content_hash(F.col("content")))
    narrow = _staged(rows.select(key, "content_hash", "idempotency_key", ORDER, "at"), staged, "keys")
    stored = _stored(existing, incoming.sparkSession, table)
    holders = claimed if claimed is not None else (None if existing is None else stored)
    if settled:
        verdicts = narrow.select(key, ORDER, F.lit(True).alias("accepted"))
        arrivals = _all_arrivals(durable(narrow.select(key, ORDER, "at"), "arrivals"), key)
    else:
        verdicts = document_verdicts(holders, narrow, bound)
        arrivals = _accepted(narrow, verdicts, key)
    plan = _with_ids(arrivals, key, stored, taken, every)
    updates = rows.join(plan, [key, ORDER], "inner")
    return Merge(_merge(table, stored, updates, (), touched_only), _rejected(verdicts, key, "document"), verdicts)


def document_ids(incoming: DataFrame, documents: DataFrame) -> DataFrame:
    """Add ``document_id`` to rows that carry a ``document_key``."""
    return incoming.join(documents.select("document_key", F.col("id").alias("document_id")), "document_key", "inner")


def upsert_embeddings(existing: DataFrame | None, incoming: DataFrame, *, bound: bool = False, touched_only: bool = False,
                      staged: bool = False, taken: DataFrame | None = None, claimed: DataFrame | None = None,
                      every: int = SPLIT_EVERY) -> Merge:
    """Embeddings by ``vector_id``; the document stays, the rest is overwritten.

    ``incoming``: document_id, vector_id, model, dimension, trace_id,
    idempotency_key, metadata, ord, at. ``bound`` promises that idempotency keys
    are NULL or derived from the vector, so that none can be refused.
    """
    table, key = schema.EMBEDDINGS, "vector_id"
    narrow = _staged(incoming.select(key, "document_id", "idempotency_key", ORDER, "at"), staged, "keys")
    stored = _stored(existing, incoming.sparkSession, table)
    if bound:
        verdicts = narrow.select(key, ORDER, F.lit(True).alias("accepted"))
        arrivals = _all_arrivals(narrow, key, ("document_id",))
    else:
        holders = claimed if claimed is not None else (None if existing is None else stored)
        verdicts = resolve_claims(narrow, holders, key, ["idempotency_key"], ORDER)
        arrivals = _accepted(narrow, verdicts, key, ("document_id",))
    plan = _with_ids(arrivals, key, stored, taken, every)
    updates = incoming.drop("document_id").join(plan, [key, ORDER], "inner")
    return Merge(_merge(table, stored, updates, ("document_id",), touched_only), _rejected(verdicts, key, "embedding"), verdicts)


def upsert_vectors(existing: DataFrame | None, incoming: DataFrame, *, touched_only: bool = False) -> DataFrame:
    """Vector store entries by ``vector_id``: the last write wins.

    ``incoming``: vector_id, page_content, metadata, embedding, ord.
    """
    names = schema.VECTORS.names
    last = last_rows(incoming, "vector_id").select(*names)
    if existing is None or touched_only:
        return last
    untouched = existing.select(*names).join(last.select("vector_id"), "vector_id", "left_anti")
    return untouched.unionByName(last)
