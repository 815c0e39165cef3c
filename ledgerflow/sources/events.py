"""Event feeds: readers and typed projections of their raw fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import keys as K
from ..functions.jsontext import as_variant_map, json_or_default, variant_text, variant_truthy
from ..functions.text import blank_to_null, decode_keys, decode_text, field_text
from ..operators.groups import split_shared
from ..operators.ranking import SPLIT_EVERY, grouped_rank
from ..schema import EVENT
from ..session import durable

CHAT = "qa_turn"
CHUNK = "index_chunk"
DEFAULT_BACKEND = "chroma"
DEFAULT_COLLECTION = "default"
# JSON fields of a chat turn and what they are when absent.
CHAT_JSON = {"user_metadata": "{}", "assistant_metadata": "{}", "snapshot": "[]"}
# Rows are searched for their place one by one, which is dealt to all cores by files.
ORDERED_PER_FILE = 100_000


def decoded_events(raw: DataFrame) -> DataFrame:
    """A feed with its ids and field names as text, invalid bytes dropped."""
    return raw.withColumns({"event_id": decode_text(F.col("event_id")), "fields": decode_keys(F.col("fields"))})


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """All events of a parquet feed, as a batch; event ids and field names may be bytes."""
    return decoded_events(spark.read.schema(EVENT).parquet(path))


def stream_events(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same feed as a stream; ``max_files`` caps what one batch takes in."""
    reader = spark.readStream.schema(EVENT)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return decoded_events(reader.parquet(path))


def numbered_slices(events: DataFrame, cap: int, every: int = SPLIT_EVERY) -> DataFrame:
    """The events with ``slice``: 0 for the first ``cap`` in arrival order, 1 for the next, and so on.

    Events that arrive together are ordered by their fields, so a recomputed
    batch has the same slices. The numbering is cut at split points of the
    data, not made in one task.
    """
    if cap < 1:
        raise ValueError(f"a slice needs at least one event, not {cap}")
    order = _order_text(arrival_order(F.col("event_id"), F.col("arrived_at")), F.xxhash64(F.map_entries("fields")))
    # Written once: the search among the split points would make the order anew at each of its steps.
    ordered = durable(events.withColumn("_order", order), "ordered", ORDERED_PER_FILE)
    ranked = grouped_rank(ordered, [], "_order", "_rank", every)
    return ranked.withColumn("slice", F.floor((F.col("_rank") - 1) / cap).cast("long")).drop("_order", "_rank")


def distinct_events(events: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
    """One row per event id, and the dispositions of the rows left out.

    Of rows with equal ids the first to arrive stays (equal times: by a hash of
    the fields), the others become ``repeated_id``. Rows without an id are
    events of their own, under ids made from the batch, their content and a
    count. Only rows with repeated ids are shuffled, counted before, so a hot id
    stays small. ``events`` is a table that is cheap to read again.
    """
    # A row with an id needs no hash unless the id is repeated.
    content = F.xxhash64("arrived_at", F.map_entries("fields"))
    alone, rows = split_shared(events.withColumn("_who", F.coalesce("event_id", F.hex(content))), ["_who"])
    rows = durable(rows.withColumn("_hash", content), "repeats")
    first = F.min_by(F.struct("arrived_at", "fields"), F.struct("arrived_at", "_hash")).alias("e")
    named = rows.where(F.col("event_id").isNotNull()).groupBy("event_id").agg(first, F.count(F.lit(1)).alias("_n"))
    nameless = rows.where(F.col("event_id").isNull()).groupBy("_hash").agg(first, F.count(F.lit(1)).alias("_n")).select(
        F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_k"), "_hash", "e"
    )
    made = F.concat_ws("-", F.lit("none"), F.lit(batch_id), F.hex("_hash"), "_k")
    lone = F.concat_ws("-", F.lit("none"), F.lit(batch_id), "_who", F.lit(1))
    single = alone.select(F.coalesce("event_id", lone).alias("event_id"), "arrived_at", "fields")
    again = durable(named.select("event_id", "e.*").unionByName(nameless.select(made.alias("event_id"), "e.*")), "firsts")
    kept = single.unionByName(again)
    repeats = named.where("_n > 1").select(
        "event_id", F.lit(None).cast("string").alias("idempotency_key"), F.lit("repeated_id").alias("disposition"),
        F.explode(F.sequence(F.lit(2), F.col("_n"))).alias("_k"),
    )
    return kept, repeats.drop("_k")


def arrival_order(event_id: Column, arrived_at: Column) -> Column:
    """Unique arrival order: time, then the numbers of an ``ms-n`` event id, then its text."""
    return F.struct(
        F.unix_micros(arrived_at).alias("at"),
        F.coalesce(F.regexp_extract(event_id, r"^(\d{1,18})(-\d+)?$", 1).try_cast("long"), F.lit(0)).alias("ms"),
        F.coalesce(F.regexp_extract(event_id, r"^\d+-(\d{1,18})$", 1).try_cast("long"), F.lit(0)).alias("n"),
        event_id.alias("id"),
    )


def _order_text(order: Column, last: Column) -> Column:
    """``arrival_order``, then ``last``, as one text that sorts alike: texts compare many times faster than nested structs."""

    def number(value: Column) -> Column:
        # Hex digits of fixed width with the sign bit turned; NULL is the empty text and comes first.
        return F.coalesce(F.lpad(F.hex(value.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), F.lit(""))

    told = F.when(order["id"].isNull(), "0").otherwise("1")
    return F.concat(*[F.concat(number(order[n]), F.lit("\x00")) for n in ("at", "ms", "n")], told, F.coalesce(order["id"], F.lit("")), F.lit("\x00"), number(last))


def _fields() -> Column:
    return F.coalesce(F.col("fields"), F.create_map().cast("map<string,binary>"))


def _passed_on(events: DataFrame) -> list[str]:
    """Columns next to the event's own, such as a redelivery flag."""
    return [c for c in events.columns if c not in EVENT.names]


def chat_json(name: str, text: Column, exact_json: bool = True) -> Column:
    """A JSON field of a chat turn as VARIANT."""
    return json_or_default(text, CHAT_JSON[name], exact_json)


def chat_turns(events: DataFrame, exact_json: bool = True, parsed: bool = True) -> DataFrame:
    """Typed projection of chat-turn events; a NULL field map gives empty text.

    The three JSON fields are VARIANT, or with ``parsed=False`` the text that
    ``chat_json`` parses; text fields that may be absent are NULL when empty.
    ``event_id``, ``arrived_at`` and ``ord`` are kept.
    """
    f = _fields()
    text = {n: field_text(f, n) for n in ("event_type", "session_id", "question", "answer")}
    optional = {
        n: blank_to_null(field_text(f, n))
        for n in ("trace_id", "conversation_title", "user_message_id", "assistant_message_id", "idempotency_key")
    }
    json = {n: chat_json(n, field_text(f, n), exact_json) if parsed else field_text(f, n) for n in CHAT_JSON}
    return events.select(
        *_passed_on(events), "event_id", "arrived_at", arrival_order(F.col("event_id"), F.col("arrived_at")).alias("ord"),
        *[c.alias(n) for n, c in {**text, **optional, **json}.items()],
    )


def chunk_events(events: DataFrame, collection: str = DEFAULT_COLLECTION, persist_directory: str | None = None,
                 exact_json: bool = True) -> DataFrame:
    """Typed projection of chunk events; absent fields take the given defaults."""
    f = _fields()
    return events.select(
        *_passed_on(events), "event_id", "arrived_at", arrival_order(F.col("event_id"), F.col("arrived_at")).alias("ord"),
        field_text(f, "event_type").alias("event_type"),
        blank_to_null(field_text(f, "trace_id")).alias("trace_id"),
        F.coalesce(blank_to_null(field_text(f, "collection_name")), F.lit(collection)).alias("collection_name"),
        F.coalesce(blank_to_null(field_text(f, "backend")), F.lit(DEFAULT_BACKEND)).alias("backend"),
        F.coalesce(blank_to_null(field_text(f, "persist_directory")), F.lit(persist_directory)).alias("persist_directory"),
        blank_to_null(field_text(f, "embedding_model")).alias("embedding_model"),
        field_text(f, "chunk_text").alias("chunk_text"),
        json_or_default(field_text(f, "chunk_metadata"), "{}", exact_json).alias("chunk_metadata"),
        blank_to_null(field_text(f, "idempotency_key")).alias("idempotency_key"),
    )


def chunk_trace(trace_id: Column, metadata: Column) -> Column:
    """The event's trace id, else the chunk metadata's when it is not falsy."""
    value = F.try_element_at(metadata, F.lit("trace_id"))
    return F.coalesce(F.nullif(trace_id, F.lit("")), F.when(variant_truthy(value), variant_text(value)))


def metadata_text_field(metadata: Column, name: str) -> Column:
    """A metadata member as text or NULL; an empty text is kept."""
    return variant_text(F.try_element_at(metadata, F.lit(name)))


def chat_screen() -> Column:
    """``skipped_type``, ``skipped_empty`` or NULL, checked in that order."""
    return F.when(F.col("event_type") != CHAT, "skipped_type").when(F.col("session_id") == "", "skipped_empty")


def chunk_screen() -> Column:
    return F.when(F.col("event_type") != CHUNK, "skipped_type").when(F.col("chunk_text") == "", "skipped_empty")


def usable_metadata(value: Column) -> Column:
    """Chunk metadata as a map: falsy values count as empty; NULL for other non-objects."""
    empty = F.create_map().cast("map<string,variant>")
    return F.when(~variant_truthy(value), empty).otherwise(as_variant_map(value))


def chat_key() -> Column:
    return K.chat_idempotency_key(*[
        F.col(n) for n in ("idempotency_key", "session_id", "user_message_id", "assistant_message_id", "question", "answer")
    ])

