"""Deterministic keys, embedding defaults and retry arithmetic."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from .jsontext import sorted_json, variant_text, variant_truthy
from .text import strip_blank

# Key prefixes and names that stored keys must carry.
DOCUMENT_PREFIX = "doc_"
VECTOR_PREFIX = "vec_"
IDEMPOTENCY_PREFIX = "rag:idem"
RETRY_PREFIX = "rag:retry"
CHAT_STREAM = "rag:events"
CHUNK_STREAM = "rag:index-events"
DEAD_LETTER_STREAMS = {
    "rag:events": "rag:events:dlq",
    "rag:index-events": "rag:index-events:dlq",
}
UNKNOWN = "unknown"


def key_part(text: Column) -> Column:
    """Normalise a text for use in a key: blank becomes ``unknown``."""
    lowered = F.lower(strip_blank(text))
    cleaned = F.regexp_replace(lowered, r"[^\p{L}\p{N}_-]", "-")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(UNKNOWN))


def variant_key_part(value: Column) -> Column:
    """Key part of a metadata value: the number 0 is absent, the text "0" is not."""
    return key_part(F.when(variant_truthy(value), variant_text(value)))


def metadata_key_part(metadata: Column, name: str) -> Column:
    return variant_key_part(F.try_element_at(metadata, F.lit(name)))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def document_key(collection: Column, source: Column, title_path: Column, section_id: Column, chunk_id: Column, text: Column) -> Column:
    """Key of a chunk from its normalised parts, the raw collection name and its text."""
    short_hash = F.substring(content_hash(text), 1, 16)
    return F.concat(
        F.lit(DOCUMENT_PREFIX),
        F.sha2(F.concat_ws("|", collection, source, title_path, section_id, chunk_id, short_hash), 256),
    )


def chunk_document_key(collection: Column, text: Column, metadata: Column) -> Column:
    """Key of a chunk ``(text, MAP<STRING, VARIANT>)``."""
    parts = [metadata_key_part(metadata, n) for n in ("source", "title_path", "section_id", "chunk_id")]
    return document_key(collection, *parts, text)


def vector_id(doc_key: Column) -> Column:
    return F.concat(F.lit(VECTOR_PREFIX), F.sha2(doc_key, 256))


def idempotency_key(namespace: str, payload: Mapping[str, Column], fallback: Column) -> Column:
    raw = F.concat(sorted_json(payload), F.lit("|"), fallback)
    return F.concat(F.lit(f"{IDEMPOTENCY_PREFIX}:{namespace}:"), F.sha2(raw, 256))


def chat_idempotency_key(explicit: Column, session_id: Column, user_message_id: Column, assistant_message_id: Column, question: Column, answer: Column) -> Column:
    """Explicit key, else the pair of message ids, else the turn's content."""
    has_pair = (F.coalesce(user_message_id, F.lit("")) != "") & (F.coalesce(assistant_message_id, F.lit("")) != "")
    pair = F.concat_ws("|", session_id, user_message_id, assistant_message_id)
    by_pair = idempotency_key("qa_turn", {"message_pair": pair}, pair)
    by_content = idempotency_key(
        "qa_turn",
        {"session_id": session_id, "question": question, "answer": answer},
        F.coalesce(F.nullif(session_id, F.lit("")), F.lit(UNKNOWN)),
    )
    given = F.nullif(explicit, F.lit(""))
    return F.when(given.isNotNull(), given).when(has_pair, by_pair).otherwise(by_content)


def chunk_idempotency_key(explicit: Column, collection: Column, doc_key: Column, vec_id: Column) -> Column:
    derived = idempotency_key(
        "index_chunk", {"collection_name": collection, "document_key": doc_key, "vector_id": vec_id}, vec_id
    )
    return F.coalesce(F.nullif(explicit, F.lit("")), derived)


def retry_count_key(stream: Column, event_id: Column) -> Column:
    return F.concat_ws(":", F.lit(RETRY_PREFIX), stream, event_id)


def dead_letter_stream(stream: Column, names: Mapping[str, str] = DEAD_LETTER_STREAMS) -> Column:
    out = None
    for source, target in names.items():
        hit = stream == source
        out = F.when(hit, target) if out is None else out.when(hit, target)
    fallback = F.concat(stream, F.lit(":dlq"))
    return fallback if out is None else out.otherwise(fallback)


def generated_message_id(*parts: Column) -> Column:
    """Id for a message that came without one: stable, so a replay repeats it."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def embedding_model(given: Column, configured: str | None = None) -> Column:
    """Trimmed model name, else the configured one, else ``unknown``."""
    return F.coalesce(F.nullif(strip_blank(given), F.lit("")), F.lit(configured or UNKNOWN))


def embedding_dimension(given: Column, vector: Column, probed: int = 0) -> Column:
    """Explicit dimension, else the vector's length, else that of a probe vector (0 if there was none)."""
    return F.coalesce(given, F.array_size(vector), F.lit(probed)).cast("int")


def backoff_seconds(attempt: Column, base: float = 1.0, cap: float = 60.0) -> Column:
    """Delay before the next try: base (uncapped) first, then doubling up to ``cap``."""
    grown = F.least(F.lit(float(base)) * F.pow(F.lit(2.0), attempt - 1), F.lit(float(cap)))
    return F.when(attempt <= 1, F.lit(float(base))).otherwise(grown)


def iso_timestamp(ts: Column) -> Column:
    """ISO-8601 with offset, without the fraction when it is zero (UTC session zone)."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")
    fraction = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return F.when(F.unix_micros(ts) % 1_000_000 == 0, whole).otherwise(fraction)
