"""Table and event schemas with their declared keys, references and lengths."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

S, L, I, TS = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType()


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str
    parent_column: str = "id"
    on_delete: str = "cascade"


@dataclass(frozen=True)
class Table:
    """A table: columns as ``(name, type, nullable, max length or None)``."""

    name: str
    columns: tuple[tuple, ...]
    unique: tuple[tuple[str, ...], ...]
    references: tuple[ForeignKey, ...] = field(default=())

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(n, t, nullable) for n, t, nullable, _ in self.columns])

    @property
    def key(self) -> str:
        """The natural key rows are merged on."""
        return self.unique[0][0]

    @property
    def required(self) -> list[str]:
        return [n for n, _, nullable, _ in self.columns if not nullable]

    @property
    def limits(self) -> dict[str, int]:
        return {n: limit for n, _, _, limit in self.columns if limit}


_ID = ("id", L, False, None)
_TIMES = (("created_at", TS, False, None), ("updated_at", TS, False, None))
_TRACE = (("trace_id", S, True, 64), ("idempotency_key", S, True, 191))

CONVERSATIONS = Table(
    "conversations",
    (_ID, ("session_id", S, False, 128), ("user_id", S, True, 128), ("title", S, True, 255), *_TIMES),
    unique=(("session_id",),),
)
MESSAGES = Table(
    "messages",
    (
        _ID, ("conversation_id", L, False, None), ("message_id", S, False, 64), *_TRACE,
        ("role", S, False, 32), ("text", S, False, None), ("seq", I, False, None), ("metadata", S, True, None), *_TIMES,
    ),
    unique=(("message_id",), ("conversation_id", "seq")),
    references=(ForeignKey("conversation_id", "conversations"),),
)
DOCUMENTS = Table(
    "documents",
    (
        _ID, ("document_key", S, False, 191), *_TRACE, ("source", S, True, 512), ("title_path", S, True, 1024),
        ("content", S, False, None), ("content_hash", S, False, 64), ("metadata", S, True, None), *_TIMES,
    ),
    unique=(("document_key",), ("content_hash",), ("idempotency_key",)),
)
EMBEDDINGS = Table(
    "embeddings",
    (
        _ID, ("document_id", L, False, None), ("vector_id", S, False, 191), *_TRACE,
        ("model", S, False, 191), ("dimension", I, False, None), ("metadata", S, True, None), *_TIMES,
    ),
    unique=(("vector_id",), ("idempotency_key",)),
    references=(ForeignKey("document_id", "documents"),),
)
TABLES = {t.name: t for t in (CONVERSATIONS, MESSAGES, DOCUMENTS, EMBEDDINGS)}

EVENT = T.StructType([
    T.StructField("event_id", S),
    T.StructField("arrived_at", TS),
    T.StructField("fields", T.MapType(S, T.BinaryType())),
])
VECTORS = T.StructType([
    T.StructField("vector_id", S), T.StructField("page_content", S),
    T.StructField("metadata", S), T.StructField("embedding", T.ArrayType(T.FloatType())),
])
LEDGER = T.StructType([
    T.StructField("idempotency_key", S), T.StructField("event_id", S), T.StructField("marked_at", TS),
])
ATTEMPTS = T.StructType([
    T.StructField("stream", S), T.StructField("event_id", S), T.StructField("attempts", I),
    T.StructField("last_failed_at", TS), T.StructField("next_attempt_at", TS),
])
DEAD_LETTERS = T.StructType([
    T.StructField(n, S)
    for n in ("source_stream", "original_event_id", "attempts", "error", "trace_id", "payload", "failed_at")
])
