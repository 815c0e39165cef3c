"""Event feeds into tables, batch by batch, with ledger, retries and dead letters."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from .. import schema
from ..functions import keys as K
from ..functions.embedding import Embedder, probe_dimension
from ..functions.jsontext import keep_last_keys, merge_metadata, metadata_text
from ..operators import retry as R
from ..operators import upsert as U
from ..operators.claims import scan_claims, sort_keys
from ..operators.dedup import WEEK_SECONDS, settle
from ..operators.groups import listed, picked, split_shared
from ..plans import chat
from ..session import durable, run_folder, scratch_table
from ..sources import events as E
from ..sources.tables import Positions, TableLog, stream_identity

DISPOSITIONS = T.StructType([T.StructField(n, T.StringType()) for n in ("event_id", "idempotency_key", "disposition")])
# Arrived events are parsed next, which takes far longer than reading them.
ROWS_PER_FILE = 8_000
# A pending retry keeps its raw event, so that a redelivery needs no source.
PENDING = T.StructType([
    *schema.ATTEMPTS.fields,
    T.StructField("arrived_at", T.TimestampType()),
    T.StructField("fields", T.MapType(T.StringType(), T.BinaryType())),
])


@dataclass
class Feed:
    """Options and shared steps of both feeds.

    ``process`` takes in one batch of a source. Everything it writes goes to the
    batch's own position in the order of all batches, and it reads earlier ones
    only, so a batch that is replayed after a failure leaves the same tables.
    What it stages is removed when it ends.

    The time of a batch decides which retries are due: the one given, else the
    ``clock``'s, else the earliest arrival in the batch, so that a backfill in
    one large batch redelivers nothing.

    ``max_events`` caps what is handled at once: a larger batch of the source is
    cut into slices of that many events in arrival order, each with a position
    and a time of its own. Change it only when no batch is half done, as a
    replay must find the slices it had.
    """

    spark: SparkSession
    root: str
    stream: str
    max_retries: int = R.MAX_RETRIES
    backoff_base_seconds: float = 1.0
    backoff_max_seconds: float = 30.0
    idle_seconds: float = R.IDLE_SECONDS
    ttl_seconds: int = WEEK_SECONDS
    retry_limit: int | None = None
    dead_letter_names: dict[str, str] = field(default_factory=lambda: dict(K.DEAD_LETTER_STREAMS))
    max_events: int | None = None
    # Time of the batch at a position; by default the earliest arrival in it.
    clock: Callable[[int], datetime] | None = None

    def __post_init__(self) -> None:
        keep_last_keys(self.spark)  # streams copy the session's settings when they start
        self.positions = Positions(self.spark, self.root)
        self.ledger = self._log("ledger", schema.LEDGER, "idempotency_key")
        self.attempts = self._log("attempts", PENDING, "event_id")
        letters = T.StructType([*schema.DEAD_LETTERS.fields, T.StructField("dlq_stream", T.StringType())])
        self.letters = self._log("dead_letters", letters, None)
        self.dispositions = self._log("dispositions", DISPOSITIONS, None)

    def _log(self, name: str, struct: T.StructType, key: str | None) -> TableLog:
        return TableLog(self.spark, self.root, name, struct, key)

    def _taken_in(self, batch: DataFrame, batch_id: int, now: datetime | None) -> DataFrame:
        """New events with the due retries ahead of them, staged; one row per event id."""
        arrived = durable(batch.select(*schema.EVENT.names), "arrived", ROWS_PER_FILE)
        fresh, repeats = E.distinct_events(arrived, batch_id)
        self._repeats = repeats
        if now is None:
            # Rows left out never arrived before the one that stays.
            now = self.clock(batch_id) if self.clock is not None else arrived.agg(F.min("arrived_at")).first()[0]
        fresh = fresh.withColumn("redelivered", F.lit(False))
        # Counters in force; mostly none, which saves the batch much work.
        self._waiting = durable(self.attempts.current(batch_id).where(F.col("attempts") > 0), "waiting")
        waiting = self._waiting.count()
        self._retrying = waiting > 0
        self._listed = listed(self._waiting, waiting)
        if now is None:
            return fresh
        if not self._retrying:
            return fresh
        order = E.arrival_order(F.col("event_id"), F.col("arrived_at"))
        due = durable(R.due_retries(self._waiting, F.lit(now), self.retry_limit, order), "due")
        again = due.select("event_id", F.lit(now).cast("timestamp").alias("arrived_at"), "fields", F.lit(True).alias("redelivered"))
        return fresh.join(listed(due.select("event_id"), due.count()), "event_id", "left_anti").unionByName(again)

    @staticmethod
    def _ahead(projected: DataFrame) -> DataFrame:
        """Order of a redelivered event: before the new ones of its batch."""
        first = F.when(F.col("redelivered"), F.lit(-1)).otherwise(F.col("ord.at"))
        return projected.withColumn("ord", F.col("ord").withField("at", first.cast("long"))).drop("redelivered")

    def _live_ledger(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Marks of the batch's keys that may still be in force at its earliest row."""
        marks = self.ledger.versions(batch_id)
        if self.ledger.is_void(batch_id):
            return marks
        earliest = rows.agg(F.min("arrived_at")).first()[0]
        if earliest is not None:
            # A plain literal, so that old files are skipped by their statistics.
            marks = marks.where(F.col("marked_at") >= F.lit(earliest - timedelta(seconds=self.ttl_seconds)))
        return durable(marks.join(rows.select("idempotency_key").distinct(), "idempotency_key", "left_semi"), "marks")

    def _finish(self, taken: DataFrame, outcome: DataFrame, failed: DataFrame, batch_id: int, payload, raw: tuple[str, ...],
                told: Callable[[DataFrame], DataFrame] = lambda dead: dead) -> None:
        """Route failures and write attempts, dead letters, ledger and dispositions.

        ``outcome``: event_id, arrived_at, idempotency_key, disposition (processed,
        duplicate, skipped_* or failed). ``failed``: event_id, error, trace_id and
        the payload columns; ``told`` may make some of them, for dead letters only.
        """
        failures = outcome.where(F.col("disposition") == "failed").select(
            F.lit(self.stream).alias("stream"), "event_id", F.col("arrived_at").alias("failed_at")
        )
        stored = self._listed if self._retrying else None
        routed = durable(R.route_failures(
            R.count_failures(failures, stored), self.max_retries,
            self.backoff_base_seconds, self.backoff_max_seconds, self.idle_seconds,
        ), "routed")
        final, failing = outcome, routed.count()
        changes = []
        if failing:
            route = listed(routed.select("event_id", F.col("disposition").alias("_route")), failing)
            final = outcome.join(route, "event_id", "left").withColumn("disposition", F.coalesce("_route", "disposition")).drop("_route")
            raw_events = taken.select("event_id", "arrived_at", "fields")
            # Written apart, as the payloads of a few need not be shuffled.
            again = durable(routed.where(F.col("disposition") == "retry"), "again")
            dead = durable(routed.where(F.col("disposition") == "dead_letter").drop("disposition"), "dead")
            retried = again.count()
            if retried:
                changes.append(raw_events.join(listed(again, retried), "event_id", "inner").select(*PENDING.names))
            if retried < failing:
                letters = R.dead_letters(told(failed.join(listed(dead, failing - retried), "event_id", "inner")), payload, raw)
                self.letters.append(
                    letters.withColumn("dlq_stream", K.dead_letter_stream(F.col("source_stream"), self.dead_letter_names)), batch_id
                )
        if self._retrying:
            settled = final.where(F.col("disposition") != "retry").join(self._listed.select("event_id"), "event_id", "left_semi")
            changes.append(settled.select(
                F.lit(self.stream).alias("stream"), "event_id", F.lit(0).alias("attempts"),
                *[F.lit(None).cast(f.dataType).alias(f.name) for f in PENDING.fields[3:]],
            ))
        if changes:
            self.attempts.append(reduce(DataFrame.unionByName, changes), batch_id)
        processed = outcome.where(F.col("disposition") == "processed")
        self.ledger.append(processed.select("idempotency_key", "event_id", F.col("arrived_at").alias("marked_at")), batch_id)
        self.dispositions.append(final.select(*DISPOSITIONS.names).unionByName(self._repeats), batch_id)

    def _process(self, batch: DataFrame, batch_id: int, now: datetime | None) -> None:
        raise NotImplementedError

    def process(self, batch: DataFrame, batch_id: int, source: str = "direct", now: datetime | None = None) -> None:
        """Take in batch ``batch_id`` of a source; the same batch again leaves the same tables."""
        with run_folder(self.spark):
            for number, part in enumerate(self._slices(batch)):
                name = f"{source}#{number}" if number else source
                with run_folder(self.spark):
                    self._process(part, self.positions.of(name, batch_id), now)

    def _slices(self, batch: DataFrame) -> list[DataFrame]:
        """The batch, in parts of at most ``max_events``."""
        if self.max_events is None:
            return [batch]
        events = batch.select(*schema.EVENT.names)
        path = scratch_table(self.spark, "slices")
        # Each slice is one file, which only its own step reads.
        E.numbered_slices(events, self.max_events).repartition("slice").write.partitionBy("slice").parquet(path)
        cut = self.spark.read.schema(T.StructType([*schema.EVENT.fields, T.StructField("slice", T.LongType())])).parquet(path)
        last = cut.agg(F.max("slice")).first()[0]
        if last is None:
            return [events]
        return [cut.where(F.col("slice") == number).drop("slice") for number in range(last + 1)]

    def redeliver(self, now: datetime) -> None:
        """Handle the retries that are due at ``now``, without new events; nothing is written if there are none."""
        if R.due_retries(self.attempts.current().where(F.col("attempts") > 0), F.lit(now)).isEmpty():
            return
        nothing = self.spark.createDataFrame([], schema.EVENT)
        micros = (now.replace(tzinfo=now.tzinfo or timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
        self.process(nothing, micros, "redelivery", now)

    def compact(self, upto: int) -> None:
        """Fold the batches up to position ``upto`` in every keyed table."""
        for log in vars(self).values():
            if isinstance(log, TableLog) and log.key is not None:
                log.compact(upto)

    def start(self, path: str, checkpoint: str, *, once: bool = True, interval: str = "1 second", max_files: int | None = None,
              now: datetime | None = None) -> StreamingQuery:
        """Consume a parquet feed: all that is there (``once``), or for ever; retries due at ``now`` (else by the wall clock) come first."""
        if now is None:
            now = datetime.now(timezone.utc).replace(tzinfo=None)
        self.redeliver(now)
        source = stream_identity(self.spark, checkpoint, uuid.uuid4().hex)
        writer = (
            E.stream_events(self.spark, path, max_files).writeStream
            .foreachBatch(lambda batch, number: self.process(batch, number, source))
            .option("checkpointLocation", checkpoint)
        )
        writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
        return writer.start()

    def processed_count(self) -> int:
        """Events processed so far."""
        return self.dispositions.versions().where(F.col("disposition") == "processed").count()


class ChatFeed(Feed):
    """``qa_turn`` events into conversations and messages."""

    def __init__(self, spark: SparkSession, root: str, stream: str = K.CHAT_STREAM, exact_json: bool = True, **options):
        super().__init__(spark, root, stream, **options)
        self.exact_json = exact_json
        self.conversations = self._log("conversations", schema.CONVERSATIONS.struct, "session_id")
        self.messages = self._log("messages", schema.MESSAGES.struct, "message_id")

    def _process(self, batch: DataFrame, batch_id: int, now: datetime | None) -> None:
        taken = self._taken_in(batch, batch_id, now)
        projected = self._ahead(E.chat_turns(taken, parsed=False))
        staged = durable(chat.screened_turns(projected, self.exact_json), "turns")
        wanted = staged.where(F.col("screen").isNull())
        narrow = wanted.select("event_id", "idempotency_key", "arrived_at", "ord", "valid")
        judged = durable(settle(narrow, self._live_ledger(narrow, batch_id), self.ttl_seconds), "judged")
        verdict = F.when(F.col("repeat"), "duplicate").when(F.col("valid"), "processed").otherwise("failed")
        outcome = judged.select("event_id", "arrived_at", "idempotency_key", verdict.alias("disposition")).unionByName(
            staged.where(F.col("screen").isNotNull()).select("event_id", "arrived_at", "idempotency_key", F.col("screen").alias("disposition"))
        )
        # Metadata are merged for the turns that are stored, not for repeats and failures.
        turns = chat.turn_rows(chat.enriched_turns(picked(wanted, judged, "valid and not repeat"), self.exact_json))
        self._write_turns(turns, batch_id)
        payload = {
            **{n: F.col(n) for n in ("event_type", "session_id", "trace_id", "question", "answer", "conversation_title",
                                     "user_message_id", "assistant_message_id", "idempotency_key")},
            **{n: F.to_json(n) for n in E.CHAT_JSON},
        }

        def told(dead: DataFrame) -> DataFrame:
            return chat.parsed_turns(dead, self.exact_json).withColumn("error", chat.metadata_error())

        self._finish(taken, outcome, wanted.drop("arrived_at"), batch_id, payload, tuple(E.CHAT_JSON), told)

    def _write_turns(self, turns: DataFrame, batch_id: int) -> None:
        sessions = turns.select("session_id")
        conversations = durable(U.upsert_conversations(
            self.conversations.current(batch_id, only=sessions), chat.conversation_rows(turns),
            touched_only=True, staged=True, taken=self.conversations.versions(batch_id).select("id"),
        ), "conversations")
        incoming = durable(
            U.conversation_ids(U.record_turns(turns), conversations.select("session_id", "id")).drop("session_id"), "incoming"
        )
        known = self.messages.versions(batch_id).select("message_id", "conversation_id", "seq")
        # Sequence numbers never change, so any version of a message will do.
        by_conversation = known.join(incoming.select("conversation_id").distinct(), "conversation_id", "left_semi")
        by_message = known.join(incoming.select("message_id").distinct(), "message_id", "left_semi")
        merged = U.upsert_messages(
            self.messages.current(batch_id, only=incoming), incoming, touched_only=True, staged=True,
            taken=self.messages.versions(batch_id).select("id"), bases=by_conversation.unionByName(by_message),
        )
        self.conversations.append(conversations, batch_id)
        self.messages.append(merged, batch_id)


class ChunkFeed(Feed):
    """``index_chunk`` events into the vector store, documents and embeddings.

    ``embed`` adds an ``embedding`` column to rows with ``page_content`` (see
    ``functions.embedding``); without it vectors are written as NULL. The stored
    dimension is the one given, else the vector's length, else that of a probe
    vector of ``embedder``, asked once, else 0.
    """

    def __init__(self, spark: SparkSession, root: str, stream: str = K.CHUNK_STREAM, collection: str = E.DEFAULT_COLLECTION,
                 persist_directory: str | None = None, model: str | None = None, dimension: int | None = None,
                 embed: Callable[[DataFrame], DataFrame] | None = None, embedder: Callable[[], Embedder] | None = None, exact_json: bool = True, **options):
        super().__init__(spark, root, stream, **options)
        self.collection, self.persist_directory = collection, persist_directory
        self.model, self.dimension, self.embed, self.exact_json = model, dimension, embed, exact_json
        self.probed = 0 if dimension is not None or embedder is None else probe_dimension(embedder)
        self.documents = self._log("documents", schema.DOCUMENTS.struct, "document_key")
        self.embeddings = self._log("embeddings", schema.EMBEDDINGS.struct, "vector_id")
        self.vectors = self._log("vectors", schema.VECTORS, "vector_id")

    def _process(self, batch: DataFrame, batch_id: int, now: datetime | None) -> None:
        taken = self._taken_in(batch, batch_id, now)
        projected = E.chunk_events(taken, self.collection, self.persist_directory, self.exact_json)
        prepared = prepared_chunks(self._ahead(projected))
        staged = durable(prepared.withColumn("content_hash", K.content_hash(F.col("chunk_text"))), "chunks")
        wanted = staged.where(F.col("screen").isNull())
        ledger = self._live_ledger(wanted, batch_id)
        narrow = wanted.select("event_id", "idempotency_key", "arrived_at", "ord", "document_key", "vector_id", "content_hash", "usable", "error")
        narrow, embedded = self._embedded(wanted, narrow, ledger)
        judged = self._judge(narrow, ledger, batch_id)
        verdict = F.when(F.col("repeat"), "duplicate").when(F.col("valid"), "processed").otherwise("failed")
        outcome = judged.select("event_id", "arrived_at", "idempotency_key", verdict.alias("disposition")).unionByName(
            staged.where(F.col("screen").isNotNull()).select("event_id", "arrived_at", "idempotency_key", F.col("screen").alias("disposition"))
        )
        # The vector is written before the tables, so refused chunks leave theirs.
        attempted = picked(wanted.where("usable"), judged, "not repeat")
        vectors = attempted.select("vector_id", F.col("chunk_text").alias("page_content"), F.col("vector_metadata").alias("metadata"), "ord")
        vectors = U.upsert_vectors(None, vectors.withColumn("embedding", F.lit(None).cast("array<float>")))
        if embedded is not None:
            vectors = vectors.drop("embedding").join(embedded.where("failure IS NULL").select("vector_id", "embedding"), "vector_id")
        self.vectors.append(vectors, batch_id)
        lengths = self.vectors.written(batch_id).select("vector_id", F.array_size("embedding").alias("length"))
        self._write_tables(picked(wanted, judged, "valid and not repeat"), lengths, batch_id)
        columns = ("event_type", "trace_id", "collection_name", "backend", "persist_directory", "embedding_model",
                   "chunk_text", "chunk_metadata", "document_key", "vector_id", "idempotency_key")
        refused = F.concat(F.lit("Failed to persist document "), F.col("document_key"))
        failed = wanted.drop("arrived_at")
        if embedded is not None:
            # Failures of the embedder are not staged with the texts.
            failed = failed.drop("error").join(durable(narrow.where("error IS NOT NULL").select("event_id", "error"), "errors"), "event_id", "left")
        failed = failed.withColumn("error", F.coalesce("error", refused)).withColumn("trace_id", F.col("event_trace"))
        payload = {n: F.col(n) for n in columns}
        payload["trace_id"] = F.col("given_trace")
        self._finish(taken, outcome, failed, batch_id, payload, ("chunk_metadata",))

    def _embedded(self, wanted: DataFrame, narrow: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Vectors ``(vector_id, embedding, failure)`` of the texts that may be stored, and the ``narrow`` columns with their failures.

        Embedders may be dear or random: every vector is computed once. Texts of
        rows under a mark of an earlier batch are repeats and not asked for. A text
        whose embedding fails is unusable with the failure as its error, like
        unusable metadata: it claims nothing, and the others of the batch go on.
        """
        if self.embed is None:
            return narrow, None
        prior = ledger.groupBy("idempotency_key").agg(F.unix_micros(F.max("marked_at")).alias("_prior"))
        free = F.col("_prior").isNull() | (F.unix_micros("arrived_at") > F.col("_prior") + self.ttl_seconds * 1_000_000)
        open_ = wanted.where("usable").join(prior, "idempotency_key", "left").where(free)
        texts = open_.select("vector_id", F.col("chunk_text").alias("page_content"), F.col("vector_metadata").alias("metadata"), "ord")
        texts = U.upsert_vectors(None, texts.withColumn("embedding", F.lit(None).cast("array<float>"))).drop("embedding")
        vectors = self.embed(texts)
        value = F.col("embedding")
        if isinstance(vectors.schema["embedding"].dataType, T.StructType):
            vectors = vectors.select("vector_id", value["vector"].cast("array<float>").alias("embedding"), value["error"].alias("failure"))
        else:
            vectors = vectors.select("vector_id", value.cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("failure"))
        vectors = durable(vectors, "embedded")
        failures = vectors.where("failure IS NOT NULL").select("vector_id", "failure")
        told = narrow.join(durable(failures, "failures"), "vector_id", "left")
        told = told.withColumns({"usable": F.col("usable") & F.col("failure").isNull(), "error": F.coalesce("error", "failure")})
        return durable(told.select(*narrow.columns), "narrow"), vectors

    def _judge(self, wanted: DataFrame, ledger: DataFrame, batch_id: int) -> DataFrame:
        """Repeats and refusals, which depend on each other: a refused chunk sets no mark, and a repeat claims nothing.

        A chunk that shares no key, text or mark with any other is as good as its
        metadata. Chunks of keys that nothing else can touch are settled by their marks alone,
        and those whose text or key a settled document holds are refused. What is
        left is walked once, in order, within each group of keys that share a
        text or a mark. ``valid`` becomes whether the chunk is accepted.
        """
        claims = ["content_hash", "idempotency_key"]
        key, mark = "document_key", "idempotency_key"
        plain = ["event_id", mark, "arrived_at", "ord", "valid"]
        prior = ledger.groupBy(mark).agg(F.unix_micros(F.max("marked_at")).alias("_prior"))
        narrow = wanted.select("event_id", mark, "arrived_at", "ord", key, "content_hash", F.col("usable").alias("valid")).join(prior, mark, "left")
        columns = [key, *claims]
        held = self.documents.current(batch_id, only=narrow)
        by_hash = self.documents.current(batch_id, only=narrow, on="content_hash")
        by_mark = self.documents.current(batch_id, only=narrow, on=mark)
        stored = durable(held.select(*columns).unionByName(by_hash.select(*columns)).unionByName(by_mark.select(*columns)).distinct(), "held")
        alone, rest = split_shared(narrow, columns, stored)
        easy = alone.where("_prior IS NULL").select(*plain).withColumn("repeat", F.lit(False))
        narrow = durable(rest.unionByName(alone.where("_prior IS NOT NULL")), "narrow")
        rows = narrow.withColumns({
            "_valid": F.col("valid"), "_marked": F.col("_prior").isNotNull(), "_mark": F.col(mark), "_now": F.unix_micros("arrived_at"),
        })
        fates = durable(sort_keys(rows, stored, key, claims, "ord", mark), "fates")
        fated = durable(narrow.join(fates, key), "fated")
        free = settle(fated.where("fate = 'free'").select(*plain), ledger, self.ttl_seconds)
        lost = fated.where("fate = 'lost'").select(*plain).withColumns({"valid": F.lit(False), "repeat": F.lit(False)})
        judged = easy.unionByName(free).unionByName(lost)
        open_ = fates.where("fate IS NULL").select(key)
        if not open_.isEmpty():
            hard = rows.join(open_, key, "left_semi")
            done = scan_claims(hard, fates, stored, rows, key, claims, "ord", self.ttl_seconds * 1_000_000)
            done = done.select(F.col("ord.id").alias("event_id"), F.col("accepted").alias("valid"), "repeat")
            judged = judged.unionByName(hard.select(*plain[:-1]).join(done, "event_id"))
        return durable(judged, "judged")

    def _write_tables(self, accepted: DataFrame, lengths: DataFrame, batch_id: int) -> None:
        incoming = accepted.select(
            "document_key", F.col("chunk_text").alias("content"), "source", "title_path", F.col("event_trace").alias("trace_id"),
            # The stored document repeats the vector's metadata: it was enriched first.
            "idempotency_key", F.col("vector_metadata").alias("metadata"), "ord", F.col("arrived_at").alias("at"),
        )
        # Claims are settled already; all of these rows are accepted.
        merged = U.upsert_documents(
            self.documents.current(batch_id, only=accepted.select("document_key")), incoming, settled=True,
            touched_only=True, staged=True, taken=self.documents.versions(batch_id).select("id"),
        )
        self.documents.append(merged.rows, batch_id)
        if self.dimension is not None or self.embed is None:
            sized = accepted.withColumn("length", F.lit(None).cast("int"))
        else:
            sized = accepted.join(lengths, "vector_id", "left")
        few = F.struct("collection_name", "document_key", F.col("event_trace").alias("trace_id"))
        rows = U.document_ids(sized, self.documents.written(batch_id).select("document_key", "id")).select(
            "document_id", "vector_id", F.col("event_trace").alias("trace_id"), "idempotency_key",
            K.embedding_model(F.col("embedding_model"), self.model).alias("model"),
            F.coalesce(F.lit(self.dimension).cast("int"), "length", F.lit(self.probed)).cast("int").alias("dimension"),
            F.to_json(few, {"ignoreNullFields": "false"}).alias("metadata"), "ord", F.col("arrived_at").alias("at"),
        )
        rows = durable(rows, "vectors")
        # A vector and its document carry the same idempotency keys, so what the
        # documents accepted the embeddings accept.
        vectors = U.upsert_embeddings(
            self.embeddings.current(batch_id, only=accepted.select("vector_id")), rows, bound=True,
            touched_only=True, staged=True, taken=self.embeddings.versions(batch_id).select("id"),
        )
        self.embeddings.append(vectors.rows, batch_id)


def prepared_chunks(projected: DataFrame) -> DataFrame:
    """Screen, key and enrich projected chunk events; metadata become JSON texts."""
    usable = E.usable_metadata(F.col("chunk_metadata"))
    base = projected.withColumn("_usable", usable).withColumn(
        "_meta", F.coalesce("_usable", F.create_map().cast("map<string,variant>"))
    )
    keyed = base.withColumn("document_key", K.chunk_document_key(F.col("collection_name"), F.col("chunk_text"), F.col("_meta")))
    keyed = keyed.withColumn("vector_id", K.vector_id(F.col("document_key")))
    keyed = keyed.withColumn("event_trace", E.chunk_trace(F.col("trace_id"), F.col("_meta")))
    keyed = keyed.withColumn("idempotency_key", K.chunk_idempotency_key(
        F.col("idempotency_key"), F.col("collection_name"), F.col("document_key"), F.col("vector_id")
    ))
    full = {n: F.col(n) for n in ("collection_name", "document_key", "vector_id", "idempotency_key")} | {"trace_id": F.col("event_trace")}
    enriched = metadata_text(merge_metadata(F.col("_meta"), full))
    return keyed.select(
        "event_id", "arrived_at", "ord", "event_type", F.col("trace_id").alias("given_trace"), "event_trace",
        "collection_name", "backend", "persist_directory", "embedding_model", "chunk_text",
        F.to_json("chunk_metadata").alias("chunk_metadata"), "document_key", "vector_id", "idempotency_key",
        E.chunk_screen().alias("screen"), F.col("_usable").isNotNull().alias("usable"),
        F.when(F.col("_usable").isNull(), chat.not_a_mapping(F.col("chunk_metadata"))).alias("error"),
        E.metadata_text_field(F.col("_meta"), "source").alias("source"),
        E.metadata_text_field(F.col("_meta"), "title_path").alias("title_path"),
        enriched.alias("vector_metadata"),
    )
