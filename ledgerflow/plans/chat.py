"""Chat turns: from projected events to conversation and message rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.jsontext import as_variant_map, is_object, merge_metadata, metadata_text, variant_kind
from ..operators import upsert as U
from ..operators.ranking import SPLIT_EVERY
from ..session import durable
from ..sources.events import CHAT_JSON, chat_json, chat_key, chat_screen


class Chat(NamedTuple):
    conversations: DataFrame
    messages: DataFrame


def not_a_mapping(value: Column) -> Column:
    """Error text for metadata that is valid JSON but not an object."""
    kind = variant_kind(value)
    names = {"array": "list", "string": "str", "boolean": "bool", "integer": "int", "decimal": "float"}
    name = F.lit("NoneType")
    for k, n in names.items():
        name = F.when(kind == k, n).otherwise(name)
    return F.concat(F.lit("'"), name, F.lit("' object is not a mapping"))


def prepared_turns(projected: DataFrame) -> DataFrame:
    """Screen, key and enrich projected chat turns.

    Adds ``screen`` (why a row is skipped, or NULL), ``valid`` with ``error``,
    and replaces ``idempotency_key`` by the effective key. Metadata become JSON
    texts holding the event id, trace id, key and, for the assistant, the
    snapshot; the payload's own JSON fields are kept as text next to them.
    """
    keyed = projected.withColumn("given_key", F.col("idempotency_key")).withColumn("idempotency_key", chat_key())
    user, assistant = F.col("user_metadata"), F.col("assistant_metadata")
    valid = is_object(user) & is_object(assistant)
    return keyed.select(
        "event_id", "arrived_at", "ord", "event_type", "session_id", "trace_id", "question", "answer",
        "conversation_title", "user_message_id", "assistant_message_id", "idempotency_key",
        chat_screen().alias("screen"), valid.alias("valid"), metadata_error().alias("error"),
        F.to_json(user).alias("user_metadata_raw"), F.to_json(assistant).alias("assistant_metadata_raw"),
        F.to_json("snapshot").alias("snapshot"), *[c.alias(n) for n, c in _metadata_texts().items()],
    )


def screened_turns(projected: DataFrame, exact_json: bool = True) -> DataFrame:
    """Turns projected with their JSON fields as text, screened and keyed like ``prepared_turns``.

    Only ``valid`` looks into the metadata; ``enriched_turns`` makes what is
    stored of them, for the turns that are kept.
    """
    user, assistant = (chat_json(n, F.col(n), exact_json) for n in ("user_metadata", "assistant_metadata"))
    return projected.withColumn("idempotency_key", chat_key()).select(
        "event_id", "arrived_at", "ord", "event_type", "session_id", "trace_id", "question", "answer",
        "conversation_title", "user_message_id", "assistant_message_id", "idempotency_key", *CHAT_JSON,
        chat_screen().alias("screen"), (is_object(user) & is_object(assistant)).alias("valid"),
    )


def parsed_turns(screened: DataFrame, exact_json: bool = True) -> DataFrame:
    """Screened turns with their JSON fields as VARIANT."""
    return screened.withColumns({n: chat_json(n, F.col(n), exact_json) for n in CHAT_JSON})


def enriched_turns(screened: DataFrame, exact_json: bool = True) -> DataFrame:
    """Screened turns that are to be stored, with the metadata texts of ``prepared_turns``."""
    parsed = parsed_turns(screened, exact_json)
    return parsed.withColumns(_metadata_texts())


def metadata_error() -> Column:
    """Why a parsed turn is not valid."""
    user, assistant = F.col("user_metadata"), F.col("assistant_metadata")
    return F.when(~is_object(user), not_a_mapping(user)).when(~is_object(assistant), not_a_mapping(assistant))


def _metadata_texts() -> dict[str, Column]:
    """The metadata to be stored of a parsed and keyed turn."""
    common = {"redis_event_id": F.col("event_id"), "trace_id": F.col("trace_id"), "idempotency_key": F.col("idempotency_key")}
    return {
        "user_metadata": metadata_text(merge_metadata(as_variant_map(F.col("user_metadata")), common)),
        "assistant_metadata": metadata_text(merge_metadata(as_variant_map(F.col("assistant_metadata")), {**common, "snapshot": F.col("snapshot")})),
    }


def turn_rows(prepared: DataFrame) -> DataFrame:
    """Prepared turns in the shape ``record_turns`` takes."""
    return prepared.select(
        "session_id", F.col("question").alias("user_text"), F.col("answer").alias("assistant_text"),
        "conversation_title", "user_message_id", "assistant_message_id", "trace_id", "idempotency_key",
        "user_metadata", "assistant_metadata", "event_id", "ord", F.col("arrived_at").alias("at"),
    )


def conversation_rows(turns: DataFrame) -> DataFrame:
    user = F.col("user_id") if "user_id" in turns.columns else F.lit(None).cast("string")
    return turns.select("session_id", user.alias("user_id"), F.col("conversation_title").alias("title"), "ord", "at")


def record_chat_turns(turns: DataFrame, conversations: DataFrame | None = None, messages: DataFrame | None = None,
                      every: int = SPLIT_EVERY) -> Chat:
    """Conversation upsert, then both messages of each turn, as whole tables."""
    merged = durable(U.upsert_conversations(conversations, conversation_rows(turns), every=every), "conversations")
    incoming = U.conversation_ids(U.record_turns(turns), merged.select("session_id", "id"))
    return Chat(merged, U.upsert_messages(messages, incoming.drop("session_id"), every=every))
