"""Registered queries over the given tables, each next to the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema
from ..functions import keys as K
from ..functions.embedding import embed_column, embed_texts
from ..functions.jsontext import VARIANT_MAP, as_variant_map, merge_metadata, sorted_json, strict_json, to_variant, variant_text
from ..operators import audit, dedup, history, ranking, retry
from ..operators import upsert as U
from ..operators.claims import first_claims
from ..session import durable, scratch_table
from ..sources import events as E
from ..streaming.feeds import ChatFeed, ChunkFeed, prepared_chunks
from ..streaming.marks import flag_repeats
from ..streaming.retries import route_by_timers
from . import chat, ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def report(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, folder)

        QUERIES[fn.__name__] = run
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---- documents ------------------------------------------------------------

def sql_part(x: str) -> str:
    return rf"coalesce(nullif(regexp_replace(lower(trim({x})), '[^\p{{L}}\p{{N}}_-]', '-', 'g'), ''), 'unknown')"


DOCS = f"""
docs AS (
  SELECT doc_id, text, lang, source, sha256(text) AS content_hash,
    'doc_' || sha256('library|' || {sql_part('source')} || '|' || {sql_part('lang')} || '|unknown|'
      || CASE WHEN doc_id = 0 THEN 'unknown' ELSE doc_id::VARCHAR END || '|' || substr(sha256(text), 1, 16)) AS document_key
  FROM documents),
owned AS (SELECT *, first_value(document_key) OVER (PARTITION BY content_hash ORDER BY doc_id) AS holder FROM docs),
accepted AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS id FROM owned WHERE holder = document_key)
"""


def at_seconds(n) -> F.Column:
    """A reproducible arrival time."""
    return F.timestamp_seconds(F.lit(1704067200) + n)


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    metadata = F.create_map(
        F.lit("source"), to_variant(F.col("source")), F.lit("title_path"), to_variant(F.col("lang")),
        F.lit("chunk_id"), to_variant(F.col("doc_id")),
    )
    return docs.select(
        F.col("text").alias("page_content"), metadata.alias("metadata"),
        F.col("doc_id").alias("ord"), at_seconds(F.col("doc_id")).alias("at"),
    )


def keyed(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.keyed_chunks(chunks(spark, folder), "library")


@report(f"WITH {DOCS} SELECT doc_id, document_key, 'vec_' || sha256(document_key) AS vector_id, content_hash FROM docs")
def document_keys(spark, folder):
    """KEY1-KEY4."""
    return keyed(spark, folder).select(
        F.col("ord").alias("doc_id"), "document_key", "vector_id", K.content_hash(F.col("content")).alias("content_hash")
    )


@report(f"SELECT page_id, {sql_part('url')} AS url_part, {sql_part('html')} AS html_part FROM pages")
def key_parts(spark, folder):
    """KEY1 on whole texts."""
    return table(spark, folder, "pages").select(
        "page_id", K.key_part(F.col("url")).alias("url_part"), K.key_part(F.col("html")).alias("html_part")
    )


@report(f"""WITH {DOCS} SELECT id, document_key, source, lang AS title_path, content_hash, length(text) AS chars,
  NULL::VARCHAR AS idempotency_key FROM accepted""")
def document_upsert(spark, folder):
    """UPS3 with WIN2 and WIN3."""
    rows = U.upsert_documents(None, keyed(spark, folder), bound=True).rows
    return rows.select(
        "id", "document_key", "source", "title_path", "content_hash",
        F.char_length("content").cast("long").alias("chars"), "idempotency_key",
    )


@report(f"WITH {DOCS} SELECT document_key, doc_id, 'Failed to persist document ' || document_key AS error FROM owned WHERE holder <> document_key")
def document_rejects(spark, folder):
    """UPS3: the same text under a second key."""
    rejected = U.upsert_documents(None, keyed(spark, folder), bound=True).rejected
    return rejected.select("document_key", F.col("ord").alias("doc_id"), "error")


@report(f"""WITH {DOCS} SELECT o.document_key, o.doc_id, o.holder = o.document_key AS accepted
  FROM owned o""")
def document_claims(spark, folder):
    """UPS3 verdicts by ordered claims with explicit idempotency keys."""
    rows = keyed(spark, folder).withColumn("content_hash", K.content_hash(F.col("content")))
    rows = rows.withColumn("idempotency_key", F.concat(F.lit("once-"), "document_key"))
    verdicts = U.document_verdicts(None, rows, bound=False)
    return verdicts.select("document_key", F.col("ord").alias("doc_id"), "accepted")


@report(f"""WITH {DOCS}, again AS (
    SELECT 'again-' || document_key AS document_key, doc_id, content_hash FROM docs)
  SELECT a.document_key, a.doc_id, o.document_key AS holder FROM again a JOIN accepted o USING (content_hash)""")
def stored_claims(spark, folder):
    """UPS3 against stored rows: every text is held already, whatever the new key."""
    rows = keyed(spark, folder).withColumn("content_hash", K.content_hash(F.col("content")))
    stored = U.upsert_documents(None, keyed(spark, folder), bound=True).rows
    again = rows.select(F.concat(F.lit("again-"), "document_key").alias("document_key"), "content_hash", "ord")
    verdicts = first_claims(again, stored, "document_key", "content_hash", "ord")
    return verdicts.where(~F.col("accepted")).select("document_key", F.col("ord").alias("doc_id"), "holder")


@report(f"""WITH {DOCS} SELECT content_hash, min_by(document_key, doc_id) AS holder, count(*) AS claimants
  FROM docs GROUP BY content_hash""")
def content_claims(spark, folder):
    """WIN2: who holds each text by the verdicts of the upsert."""
    rows = keyed(spark, folder).withColumn("content_hash", K.content_hash(F.col("content")))
    verdicts = U.document_verdicts(None, rows, bound=True)
    return verdicts.groupBy("content_hash").agg(
        F.max(F.when(F.col("accepted"), F.col("document_key"))).alias("holder"), F.count(F.lit(1)).alias("claimants")
    )


@report(f"""WITH {DOCS} SELECT document_key, 'vec_' || sha256(document_key) AS vector_id, id AS document_id,
  id AS embedding_id FROM accepted""")
def chunk_receipts(spark, folder):
    """UPS6, JN3, SNK7."""
    return ingest.persist_chunks(chunks(spark, folder), collection="library", model="m", dimension=64, bound=True).receipts


@report(f"""WITH {DOCS} SELECT 'vec_' || sha256(d.document_key) AS vector_id, d.document_key, 'mini' AS model,
  len(e.embedding)::INTEGER AS dimension FROM accepted d JOIN embeddings e ON e.vec_id = d.doc_id""")
def embedding_upsert(spark, folder):
    """UPS4, EMB1, EMB2, JN3: vectors that belong to stored documents."""
    docs = U.upsert_documents(None, keyed(spark, folder), bound=True).rows.select("id", "document_key")
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("ord"), "embedding")
    rows = U.document_ids(keyed(spark, folder).select("document_key", "vector_id", "ord", "at").join(vectors, "ord"), docs)
    rows = rows.select(
        "document_id", "vector_id", "ord", "at", K.embedding_model(F.lit(" mini ")).alias("model"),
        K.embedding_dimension(F.lit(None).cast("int"), F.col("embedding")).alias("dimension"),
        *[F.lit(None).cast("string").alias(c) for c in ("trace_id", "idempotency_key", "metadata")],
    )
    merged = U.upsert_embeddings(None, rows, bound=True).rows
    return merged.join(docs.withColumnRenamed("id", "document_id"), "document_id").select(
        "vector_id", "document_key", "model", "dimension"
    )


@report("""SELECT 'vec_' || sha256(sha256(text)) AS vector_id, max(doc_id) AS doc_id, max_by(lang, doc_id) AS lang
  FROM documents GROUP BY text""")
def vector_upsert(spark, folder):
    """SNK5: last write wins."""
    docs = table(spark, folder, "documents")
    rows = docs.select(
        K.vector_id(K.content_hash(F.col("text"))).alias("vector_id"), F.col("text").alias("page_content"),
        F.to_json(F.struct("doc_id", "lang")).alias("metadata"), F.lit(None).cast("array<float>").alias("embedding"),
        F.col("doc_id").alias("ord"),
    )
    stored = U.upsert_vectors(None, rows)
    return stored.select(
        "vector_id", F.get_json_object("metadata", "$.doc_id").cast("long").alias("doc_id"),
        F.get_json_object("metadata", "$.lang").alias("lang"),
    )


@report(f"WITH {DOCS} SELECT 'vec_' || sha256(document_key) AS vector_id, doc_id FROM owned WHERE holder <> document_key")
def vector_orphans(spark, folder):
    """JN9: the vector of a refused chunk has no embedding row."""
    rows = keyed(spark, folder)
    stored = U.upsert_documents(None, rows, bound=True).rows
    listed = stored.select(K.vector_id(F.col("document_key")).alias("vector_id"))
    return audit.unlisted_vectors(rows.select("vector_id", F.col("ord").alias("doc_id")), listed)


@report("""SELECT vec_id, label FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.vec_id)""")
def reference_orphans(spark, folder):
    """JN7: embeddings whose document carries no label."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "label")
    return audit.orphans(vectors, table(spark, folder, "labels"), "vec_id", "doc_id")


@report(f"""WITH {DOCS}, h AS (SELECT content_hash, count(*) AS n FROM docs GROUP BY 1 HAVING count(*) > 1),
  k AS (SELECT document_key, count(*) AS n FROM docs GROUP BY 1 HAVING count(*) > 1)
  SELECT 'document_key' AS key, count(*) AS values, coalesce(sum(n), 0)::BIGINT AS rows FROM k
  UNION ALL SELECT 'content_hash', count(*), coalesce(sum(n), 0)::BIGINT FROM h
  UNION ALL SELECT 'idempotency_key', 0, 0""")
def uniqueness_audit(spark, folder):
    """AGG6 before any claim is settled."""
    rows = keyed(spark, folder).withColumn("content_hash", K.content_hash(F.col("content")))
    return audit.uniqueness_audit(rows, schema.DOCUMENTS)


@report("""SELECT 'source' AS column, 0::BIGINT AS nulls, sum((length(url) > 512)::INT)::BIGINT AS too_long FROM pages
  UNION ALL SELECT 'title_path', 0, sum((length(html) > 1024)::INT)::BIGINT FROM pages
  UNION ALL SELECT 'content', sum((html IS NULL)::INT)::BIGINT, 0 FROM pages""")
def column_audit(spark, folder):
    """AGG7 in one pass, lengths in code points."""
    rows = table(spark, folder, "pages").select(
        F.col("url").alias("source"), F.col("html").alias("title_path"), F.col("html").alias("content")
    )
    return audit.column_audit(rows, schema.DOCUMENTS)


@report(f"WITH {DOCS} SELECT document_key, row_number() OVER (ORDER BY document_key) AS id FROM docs")
def surrogate_ids(spark, folder):
    """WIN3 without a single-partition window; keys are computed once."""
    return ranking.surrogate_ids(durable(keyed(spark, folder).select("document_key"), "keys"), "document_key")


@report("""SELECT lang, source, count(*) AS stored, count(e.vec_id) AS matched FROM documents d
  LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY lang, source""")
def matched_existing(spark, folder):
    """JN5: incoming against stored rows by key."""
    docs, vectors = table(spark, folder, "documents"), table(spark, folder, "embeddings").select("vec_id")
    joined = docs.select("doc_id", "lang", "source").join(vectors, F.col("doc_id") == F.col("vec_id"), "left")
    return joined.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("stored"), F.count("vec_id").alias("matched"))


# ---- conversations --------------------------------------------------------

TURNS = """
turns AS (SELECT conv_id::VARCHAR AS session_id, conv_id, turn, role, text,
  'm-' || conv_id || '-' || turn AS message_id, conv_id * 1000000 + turn AS ord FROM conversations)
"""
CONVS = """
convs AS (SELECT session_id, row_number() OVER (ORDER BY min(ord)) AS id FROM turns GROUP BY session_id)
"""


def turns(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    none = F.lit(None).cast("string")
    order = F.col("conv_id") * 1_000_000 + F.col("turn")
    return rows.select(
        F.col("conv_id").cast("string").alias("session_id"), F.concat_ws("-", F.lit("m"), "conv_id", "turn").alias("message_id"),
        "role", "text", none.alias("trace_id"), none.alias("idempotency_key"), none.alias("metadata"),
        "turn", order.alias("ord"), at_seconds(order).alias("at"),
    )


def conversation_table(rows: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return durable(U.upsert_conversations(None, rows.select("session_id", none.alias("user_id"), none.alias("title"), "ord", "at")))


def message_table(rows: DataFrame, conversations: DataFrame, every: int = ranking.SPLIT_EVERY) -> DataFrame:
    incoming = U.conversation_ids(rows, conversations).drop("session_id", "turn")
    return U.upsert_messages(None, incoming, every=every)


@report(f"""WITH {TURNS} SELECT session_id, row_number() OVER (ORDER BY min(ord)) AS id,
  max_by(text, ord) FILTER (WHERE role = 'user') AS title, max_by(role, ord) FILTER (WHERE role <> 'user') AS user_id,
  strftime(to_timestamp(1704067200 + min(ord)) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS created_at,
  strftime(to_timestamp(1704067200 + max(ord)) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS updated_at
  FROM turns GROUP BY session_id""")
def conversation_upsert(spark, folder):
    """UPS1, AGG5, WIN3: the last title and user that are not NULL."""
    rows = turns(spark, folder).select(
        "session_id", F.when(F.col("role") != "user", F.col("role")).alias("user_id"),
        F.when(F.col("role") == "user", F.col("text")).alias("title"), "ord", "at",
    )
    merged = U.upsert_conversations(None, rows)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return merged.select("session_id", "id", "title", "user_id", stamp("created_at"), stamp("updated_at"))


@report(f"""WITH {TURNS}, old AS (SELECT session_id, max_by(text, ord) AS title FROM turns WHERE role = 'system' GROUP BY 1),
  new AS (SELECT session_id, max_by(text, ord) AS title FROM turns WHERE role = 'assistant' GROUP BY 1)
  SELECT session_id, coalesce(new.title, old.title) AS title, old.session_id IS NOT NULL AS stored
  FROM old FULL JOIN new USING (session_id)""")
def conversation_remerge(spark, folder):
    """UPS1, JN5, SET1: assistant rows merged into conversations stored from system rows."""
    rows = turns(spark, folder).select("session_id", F.lit(None).cast("string").alias("user_id"), F.col("text").alias("title"), "role", "ord", "at")
    stored = durable(U.upsert_conversations(None, rows.where(F.col("role") == "system").drop("role")))
    before = stored.select("session_id", F.lit(True).alias("stored"))
    merged = U.upsert_conversations(stored, rows.where(F.col("role") == "assistant").drop("role"))
    return merged.join(before, "session_id", "left").select("session_id", "title", F.col("stored").isNotNull().alias("stored"))


@report(f"""WITH {TURNS}, {CONVS} SELECT c.id AS conversation_id, t.message_id, t.role, t.text,
  row_number() OVER (PARTITION BY c.id ORDER BY t.ord)::INTEGER AS seq FROM turns t JOIN convs c USING (session_id)""")
def message_upsert(spark, folder):
    """UPS2, WIN1, JN1."""
    rows = turns(spark, folder)
    merged = message_table(rows, conversation_table(rows))
    return merged.select("conversation_id", "message_id", "role", "text", "seq")


@report(f"""WITH {TURNS}, s AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS n FROM turns WHERE role = 'user'),
  b AS (SELECT session_id, count(*) AS base FROM s GROUP BY 1),
  r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS n FROM turns WHERE role <> 'user')
  SELECT message_id, text, n::INTEGER AS seq FROM s
  UNION ALL SELECT message_id, text, (coalesce(base, 0) + n)::INTEGER FROM r LEFT JOIN b USING (session_id)""")
def message_continuation(spark, folder):
    """WIN1, AGG2: other rows numbered after stored user messages; user rows come again and burn no number."""
    rows = turns(spark, folder)
    conversations = conversation_table(rows)
    stored = durable(message_table(rows.where(F.col("role") == "user"), conversations))
    incoming = U.conversation_ids(rows, conversations).drop("session_id", "turn")
    return U.upsert_messages(stored, incoming).select("message_id", "text", "seq")


@report(f"""WITH {TURNS}, f AS (SELECT role || '-' || turn AS message_id, min_by(session_id, ord) AS session_id, min(ord) AS first_ord,
    max_by(text, ord) AS text, count(*) AS arrivals FROM turns GROUP BY 1)
  SELECT message_id, session_id, text, arrivals, row_number() OVER (PARTITION BY session_id ORDER BY first_ord)::INTEGER AS seq FROM f""")
def message_rebinding(spark, folder):
    """UPS2: ids reused across sessions stay with the first, the last text wins."""
    rows = turns(spark, folder).withColumn("message_id", F.concat_ws("-", "role", "turn"))
    conversations = conversation_table(rows)
    merged = message_table(rows, conversations)
    arrivals = rows.groupBy("message_id").agg(F.count(F.lit(1)).alias("arrivals"))
    back = conversations.select(F.col("id").alias("conversation_id"), "session_id")
    return merged.join(back, "conversation_id").join(arrivals, "message_id").select("message_id", "session_id", "text", "arrivals", "seq")


@report(f"WITH {TURNS} SELECT session_id, max(turn) + 2 AS next_seq FROM turns GROUP BY 1")
def next_sequences(spark, folder):
    """AGG2 on positions counted from one."""
    rows = turns(spark, folder).select(F.col("session_id").alias("conversation_id"), (F.col("turn") + 1).alias("seq"))
    return U.next_sequence(rows).select(F.col("conversation_id").alias("session_id"), (F.col("base") + 1).alias("next_seq"))


@report(f"""WITH {TURNS}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS seq FROM turns)
  SELECT session_id, message_id, role, text, seq::INTEGER AS seq FROM n WHERE seq <= 3""")
def history_pages(spark, folder):
    """JN2, SRT1: the first three messages of every session."""
    rows = turns(spark, folder)
    conversations = conversation_table(rows)
    page = history.history_pages(conversations, message_table(rows, conversations), 3)
    return page.select("session_id", "message_id", "role", "text", "seq")


PAIRS = """
pairs AS (SELECT u.conv_id::VARCHAR AS session_id, u.turn AS user_seq, u.text AS question, a.text AS answer,
  'm-' || u.conv_id || '-' || u.turn AS user_message_id, 'm-' || u.conv_id || '-' || a.turn AS assistant_message_id,
  u.conv_id * 1000000 + u.turn AS ord
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')
"""


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    paired = history.turn_pairs(table(spark, folder, "conversations"), "conv_id", "turn")
    order = F.col("conv_id") * 1_000_000 + F.col("user_seq")
    return paired.select(
        F.col("conv_id").cast("string").alias("session_id"), "user_seq", "question", "answer",
        F.concat_ws("-", F.lit("m"), "conv_id", "user_seq").alias("user_message_id"),
        F.concat_ws("-", F.lit("m"), "conv_id", "assistant_seq").alias("assistant_message_id"), order.alias("ord"),
    )


@report(f"WITH {PAIRS} SELECT session_id, user_seq, question, answer FROM pairs")
def turn_pairs(spark, folder):
    """WIN4, read side."""
    return pairs(spark, folder).select("session_id", "user_seq", "question", "answer")


def content_key(session: str, question: str, answer: str) -> str:
    return (
        f"'rag:idem:qa_turn:' || sha256('{{\"answer\": ' || to_json({answer})::VARCHAR || ', \"question\": ' || to_json({question})::VARCHAR"
        f" || ', \"session_id\": ' || to_json({session})::VARCHAR || '}}|' || coalesce(nullif({session}, ''), 'unknown'))"
    )


@report(f"""WITH {PAIRS}, p AS (SELECT *, session_id || '|' || user_message_id || '|' || assistant_message_id AS pair FROM pairs)
  SELECT session_id, user_seq, 'given-' || user_seq AS by_given,
  'rag:idem:qa_turn:' || sha256('{{"message_pair": ' || to_json(pair)::VARCHAR || '}}|' || pair) AS by_pair,
  {content_key('session_id', 'question', 'answer')} AS by_content FROM p""")
def chat_idempotency_keys(spark, folder):
    """KEY5, KEY6, JS3: the three ways a turn gets its key."""
    none = F.lit(None).cast("string")
    c = {n: F.col(n) for n in ("session_id", "user_message_id", "assistant_message_id", "question", "answer")}
    given = F.concat(F.lit("given-"), F.col("user_seq"))
    key = K.chat_idempotency_key
    return pairs(spark, folder).select(
        "session_id", "user_seq",
        key(given, *c.values()).alias("by_given"),
        key(none, *c.values()).alias("by_pair"),
        key(none, c["session_id"], c["user_message_id"], none, c["question"], c["answer"]).alias("by_content"),
    )


def pair_turns(spark: SparkSession, folder: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return pairs(spark, folder).select(
        "session_id", F.col("question").alias("user_text"), F.col("answer").alias("assistant_text"),
        F.col("question").alias("conversation_title"), "user_message_id", none.alias("assistant_message_id"),
        none.alias("trace_id"), F.concat_ws("/", "session_id", "user_seq").alias("idempotency_key"),
        none.alias("user_metadata"), none.alias("assistant_metadata"), "ord", at_seconds(F.col("ord")).alias("at"),
    )


@report(f"""WITH {PAIRS}, m AS (
    SELECT session_id, user_message_id AS message_id, 'user' AS role, question AS text, ord * 2 AS o FROM pairs
    UNION ALL SELECT session_id, substr(sha256(session_id || '|' || session_id || '/' || user_seq || '|assistant'), 1, 32),
      'assistant', answer, ord * 2 + 1 FROM pairs),
  t AS (SELECT session_id, max_by(question, ord) AS title FROM pairs GROUP BY 1)
  SELECT session_id, title, message_id, role, text, row_number() OVER (PARTITION BY session_id ORDER BY o)::INTEGER AS seq
  FROM m JOIN t USING (session_id)""")
def recorded_turns(spark, folder):
    """UPS5, WIN4 write side, JN1."""
    recorded = chat.record_chat_turns(pair_turns(spark, folder))
    sessions = recorded.conversations.select(F.col("id").alias("conversation_id"), "session_id", "title")
    return recorded.messages.join(sessions, "conversation_id").select("session_id", "title", "message_id", "role", "text", "seq")


@report(f"""WITH {TURNS}, gone AS (SELECT DISTINCT session_id FROM turns WHERE role = 'system')
  SELECT message_id, session_id IN (SELECT session_id FROM gone) AS removed FROM turns""")
def cascade_delete(spark, folder):
    """JN8: sessions with a system message are deleted with their messages."""
    rows = turns(spark, folder)
    deleted = rows.where(F.col("role") == "system").select("session_id").distinct()
    kept, removed = history.cascade_delete(rows.select("session_id", "message_id"), deleted, "session_id", "session_id")
    return kept.select("message_id", F.lit(False).alias("removed")).unionByName(removed.select("message_id", F.lit(True).alias("removed")))


# ---- event feeds ----------------------------------------------------------

def feed(spark: SparkSession, folder: str, **fields) -> DataFrame:
    """The events table as a raw feed with the given text fields."""
    rows = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    entries = [c for name, col in fields.items() for c in (F.lit(name), col.cast("string").cast("binary"))]
    return rows.select(
        F.concat(F.col("event_id").cast("string"), F.lit("-0")).alias("event_id"), F.col("ts").alias("arrived_at"),
        F.create_map(*entries).alias("fields"),
    )


def chat_feed(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    return feed(
        spark, folder, event_type=F.when(kind == "signup", "other").otherwise("qa_turn"),
        session_id=F.when(kind == "view", "").otherwise(F.concat(F.lit("u"), F.col("user_id"))),
        question=F.lit("q"), answer=F.col("event_type"), trace_id=F.when(kind == "click", "").otherwise(kind),
        user_metadata=F.when(kind == "error", F.concat(F.col("props"), F.lit(" x"))).otherwise(F.col("props")),
        snapshot=F.when(kind == "click", "").otherwise(F.concat(F.lit("["), F.col("props"), F.lit("]"))),
    )


@report(f"""SELECT event_id || '-0' AS event_id, CASE WHEN event_type = 'signup' THEN 'other' ELSE 'qa_turn' END AS event_type,
  CASE WHEN event_type = 'view' THEN '' ELSE 'u' || user_id END AS session_id,
  CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS trace_id, event_type AS answer,
  CASE WHEN event_type = 'error' THEN NULL ELSE (props->>'k')::INTEGER END AS k,
  CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS snapshots, NULL::VARCHAR AS conversation_title,
  CASE WHEN event_type = 'signup' THEN 'skipped_type' WHEN event_type = 'view' THEN 'skipped_empty' END AS screen FROM events""")
def chat_event_fields(spark, folder):
    """PRJ1-PRJ5, FLT1, FLT2, JS1: typed chat turns and why some are skipped."""
    projected = E.chat_turns(chat_feed(spark, folder))
    return projected.select(
        "event_id", "event_type", "session_id", "trace_id", "answer",
        F.try_variant_get("user_metadata", "$.k", "int").alias("k"),
        F.size(F.try_variant_get("snapshot", "$", "array<variant>")).alias("snapshots"),
        "conversation_title", E.chat_screen().alias("screen"),
    )


@report("""SELECT CASE WHEN event_type = 'signup' THEN 'skipped_type' WHEN event_type = 'view' THEN 'skipped_empty' ELSE 'taken' END AS disposition,
  count(*) AS events FROM events GROUP BY 1""")
def disposition_counts(spark, folder):
    """AGG1."""
    projected = E.chat_turns(chat_feed(spark, folder))
    return projected.groupBy(F.coalesce(E.chat_screen(), F.lit("taken")).alias("disposition")).agg(F.count(F.lit(1)).alias("events"))


@report(f"""SELECT event_id || '-0' AS event_id, CASE WHEN event_type <> 'error' THEN (props->>'k')::INTEGER END AS k, event_id || '-0' AS redis_event_id,
  CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS trace_id,
  {content_key("('u' || user_id)", "'q'", "event_type")} AS idempotency_key, CASE WHEN event_type = 'error' THEN 3 ELSE 4 END::INTEGER AS user_entries,
  4::INTEGER AS assistant_entries FROM events WHERE event_type NOT IN ('signup', 'view')""")
def chat_metadata(spark, folder):
    """MAP1, MAP2, JS2, KEY5-6: metadata stored with both messages; unparsable ones fall back to the default."""
    prepared = chat.prepared_turns(E.chat_turns(chat_feed(spark, folder)))
    rows = prepared.where(F.col("screen").isNull())
    get = lambda n: F.get_json_object("user_metadata", f"$.{n}")
    return rows.select(
        "event_id", get("k").cast("int").alias("k"), get("redis_event_id").alias("redis_event_id"), get("trace_id").alias("trace_id"),
        get("idempotency_key").alias("idempotency_key"),
        F.size(F.json_object_keys("user_metadata")).alias("user_entries"),
        F.size(F.json_object_keys("assistant_metadata")).alias("assistant_entries"),
    )


NEXT_MARKS = """
nexts AS (SELECT a.key, a.t, (SELECT min(b.t) FROM rows b WHERE b.valid AND b.key = a.key AND b.t > a.t + 604800000000) AS n
  FROM (SELECT DISTINCT key, t FROM rows WHERE valid) a),
kept AS (
  SELECT key, min(t) AS t FROM rows WHERE valid GROUP BY key
  UNION ALL
  SELECT k.key, n.n FROM kept k JOIN nexts n ON n.key = k.key AND n.t = k.t WHERE n.n IS NOT NULL)
"""


@report(f"""WITH RECURSIVE rows AS (SELECT event_id, user_id || '/' || event_type AS key, epoch_us(ts) AS t, true AS valid FROM events),
  {NEXT_MARKS} SELECT k.key, min(r.event_id) AS event_id FROM kept k JOIN rows r ON r.key = k.key AND r.t = k.t GROUP BY k.key, k.t""")
def ttl_marks(spark, folder):
    """STR2: events that survive a seven-day repeat rule per user and type."""
    rows = table(spark, folder, "events").select(
        F.concat_ws("/", "user_id", "event_type").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("now"), "event_id"
    )
    return dedup.first_seen(rows, "key", "now", "event_id").select("key", "event_id")


TURN_MARKS = f"""
rows AS (SELECT event_id, user_id::VARCHAR AS key, epoch_us(ts) AS t, event_type <> 'error' AS valid, event_type
  FROM events WHERE event_type NOT IN ('signup', 'view')),
{NEXT_MARKS},
marks AS (SELECT k.key, k.t, min(r.event_id) AS event_id FROM kept k JOIN rows r ON r.key = k.key AND r.t = k.t AND r.valid GROUP BY 1, 2)
"""


def repeated_turns(spark: SparkSession, folder: str) -> DataFrame:
    """A feed in which a user repeats one turn; error events carry unusable metadata."""
    kind = F.col("event_type")
    return feed(
        spark, folder, event_type=F.when(kind == "signup", "other").otherwise("qa_turn"),
        session_id=F.when(kind == "view", "").otherwise(F.col("user_id").cast("string")), question=F.lit("q"),
        user_metadata=F.when(kind == "error", "[1]").otherwise(F.col("props")),
    )


@report(f"""WITH RECURSIVE {TURN_MARKS}
  SELECT r.event_id || '-0' AS event_id, CASE WHEN EXISTS (SELECT 1 FROM marks m WHERE m.key = r.key AND r.t BETWEEN m.t AND m.t + 604800000000
      AND (r.t > m.t OR r.event_id > m.event_id)) THEN 'duplicate' WHEN r.valid THEN 'processed' ELSE 'failed' END AS disposition
  FROM rows r
  UNION ALL SELECT event_id || '-0', CASE event_type WHEN 'signup' THEN 'skipped_type' ELSE 'skipped_empty' END
  FROM events WHERE event_type IN ('signup', 'view')""")
def chat_dispositions(spark, folder):
    """STR1, STR7: each event's outcome; failing events set no mark and leave their key free."""
    prepared = chat.prepared_turns(E.chat_turns(repeated_turns(spark, folder)))
    wanted = prepared.where(F.col("screen").isNull()).select("event_id", "idempotency_key", "arrived_at", "ord", "valid")
    judged = dedup.settle(durable(wanted), None)
    outcome = F.when(F.col("repeat"), "duplicate").when(F.col("valid"), "processed").otherwise("failed")
    skipped = prepared.where(F.col("screen").isNotNull()).select("event_id", F.col("screen").alias("disposition"))
    return judged.select("event_id", outcome.alias("disposition")).unionByName(skipped)


@report(f"""WITH RECURSIVE {TURN_MARKS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, event_id) AS n FROM marks)
  SELECT key AS session_id, 'user' AS role, 'q' AS text, (2 * n - 1)::INTEGER AS seq, event_id || '-0' AS redis_event_id FROM numbered
  UNION ALL SELECT key, 'assistant', '', (2 * n)::INTEGER, event_id || '-0' FROM numbered""")
def chat_feed_messages(spark, folder):
    """STR7, SNK1-2: the whole feed as one batch, down to the stored messages."""
    chat_rows = ChatFeed(spark, scratch_table(spark, "feed"))
    chat_rows.process(repeated_turns(spark, folder), 0)
    sessions = chat_rows.conversations.current().select(F.col("id").alias("conversation_id"), "session_id")
    return chat_rows.messages.current().join(sessions, "conversation_id").select(
        "session_id", "role", "text", "seq", F.get_json_object("metadata", "$.redis_event_id").alias("redis_event_id")
    )


@report("""WITH mark AS (SELECT user_id, max(ts) AS marked_at FROM events WHERE event_type = 'purchase' GROUP BY 1),
  now AS (SELECT max(ts) AS t FROM events)
  SELECT e.event_id, e.user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM mark m, now
    WHERE m.user_id = e.user_id AND epoch_us(m.marked_at) + 604800000000 >= epoch_us(now.t))""")
def unprocessed_events(spark, folder):
    """STR1, JN4: events of users without a purchase mark in force."""
    rows = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ledger = rows.where(F.col("event_type") == "purchase").groupBy("user_id").agg(F.max("ts").alias("marked_at"))
    ledger = ledger.withColumnRenamed("user_id", "idempotency_key")
    now = rows.agg(F.max("ts").alias("t")).scalar()
    return dedup.drop_processed(rows.withColumnRenamed("user_id", "idempotency_key"), ledger, now).select(
        "event_id", F.col("idempotency_key").alias("user_id")
    )


FAILURES = """
fresh AS (SELECT event_type AS stream, user_id || '/' || (isodow(ts) - 1) AS event_id, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at
  FROM events WHERE event_type = 'error' GROUP BY 1, 2),
old AS (SELECT user_id || '/' || (isodow(ts) - 1) AS event_id, count(*) AS n, min(ts) AS at FROM events WHERE event_type = 'view' GROUP BY 1),
counted AS (SELECT f.stream, f.event_id, f.last_at,
    (f.n + CASE WHEN epoch_us(o.at) + 172800000000 >= epoch_us(f.first_at) THEN o.n ELSE 0 END)::INTEGER AS attempts
  FROM fresh f LEFT JOIN old o USING (event_id)),
routed AS (SELECT *, CASE WHEN attempts >= 5 THEN 'dead_letter' ELSE 'retry' END AS disposition,
    CASE WHEN attempts >= 5 THEN NULL WHEN attempts <= 1 THEN 1.0::DOUBLE ELSE least(pow(2.0::DOUBLE, attempts - 1), 30.0::DOUBLE) END AS backoff_seconds
  FROM counted)
"""


def routed(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    user = F.concat_ws("/", "user_id", F.weekday("ts")).alias("event_id")
    failed = rows.where(F.col("event_type") == "error").select(F.col("event_type").alias("stream"), user, F.col("ts").alias("failed_at"))
    old = rows.where(F.col("event_type") == "view").groupBy(user).agg(F.count(F.lit(1)).alias("attempts"), F.min("ts").alias("last_failed_at"))
    return retry.route_failures(retry.count_failures(failed, old.withColumn("stream", F.lit("error"))))


@report(f"WITH {FAILURES} SELECT stream, event_id, attempts, disposition, backoff_seconds, 'rag:retry:' || stream || ':' || event_id AS counter FROM routed")
def failure_routes(spark, folder):
    """AGG3, JN6, STR3, STR4, RET1, KEY8."""
    return routed(spark, folder).select(
        "stream", "event_id", "attempts", "disposition", "backoff_seconds",
        K.retry_count_key(F.col("stream"), F.col("event_id")).alias("counter"),
    )


@report(f"""WITH {FAILURES} SELECT event_id, attempts FROM routed, (SELECT max(ts) AS t FROM events)
  WHERE disposition = 'retry' AND epoch_us(last_at) + 60000000 <= epoch_us(t)""")
def due_retries(spark, folder):
    """SRC4: retries that are due at the end of the feed (backoff never exceeds the idle time)."""
    now = table(spark, folder, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("t")).scalar()
    return retry.due_retries(routed(spark, folder), now).select("event_id", "attempts")


@report(f"""WITH {FAILURES} SELECT stream AS source_stream, event_id AS original_event_id, attempts::VARCHAR AS attempts, 'boom' AS error, '' AS trace_id,
  '{{"event_id": "' || event_id || '", "stream": "error"}}' AS payload,
  strftime(last_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(last_at) % 1000000 = 0 THEN '' ELSE strftime(last_at, '.%f') END || '+00:00' AS failed_at,
  'error:dlq' AS dlq_stream FROM routed WHERE disposition = 'dead_letter'""")
def dead_letters(spark, folder):
    """STR5, RET2, KEY10, JS3."""
    dead = routed(spark, folder).where(F.col("disposition") == "dead_letter")
    dead = dead.withColumn("error", F.lit("boom")).withColumn("trace_id", F.lit(None).cast("string"))
    letters = retry.dead_letters(dead, {"stream": F.col("stream"), "event_id": F.col("event_id")})
    return letters.withColumn("dlq_stream", K.dead_letter_stream(F.col("source_stream")))


@report("""SELECT event_type AS source, CASE event_type WHEN 'click' THEN 'rag:events' WHEN 'view' THEN 'rag:index-events' ELSE event_type END AS stream,
  CASE event_type WHEN 'click' THEN 'rag:events:dlq' WHEN 'view' THEN 'rag:index-events:dlq' ELSE event_type || ':dlq' END AS dlq_stream,
  count(*) AS events FROM events GROUP BY event_type""")
def dead_letter_streams(spark, folder):
    """KEY10."""
    kind = F.col("event_type")
    stream = F.when(kind == "click", K.CHAT_STREAM).when(kind == "view", K.CHUNK_STREAM).otherwise(kind)
    rows = table(spark, folder, "events").select(kind.alias("source"), stream.alias("stream"))
    return rows.withColumn("dlq_stream", K.dead_letter_stream(F.col("stream"))).groupBy("source", "stream", "dlq_stream").agg(
        F.count(F.lit(1)).alias("events")
    )


@report("""SELECT event_id, (props->>'k')::INTEGER AS k, NULL::VARCHAR AS trailing, NULL::VARCHAR AS two, props->>'k' AS k_text FROM events""")
def strict_json_fields(spark, folder):
    """JS1, PRJ4, PRJ8: trailing garbage and a second value are refused."""
    props = F.col("props")
    second = strict_json(F.concat(props, F.lit(","), props))
    return table(spark, folder, "events").select(
        "event_id", F.try_variant_get(strict_json(props), "$.k", "int").alias("k"),
        F.to_json(strict_json(F.concat(props, F.lit(" x")))).alias("trailing"), F.to_json(second).alias("two"),
        variant_text(F.try_element_at(as_variant_map(strict_json(props)), F.lit("k"))).alias("k_text"),
    )


@report("""SELECT doc_id, md5('{"lang": ' || to_json(lang)::VARCHAR || ', "text": ' || to_json(text)::VARCHAR || '}') AS digest FROM documents""")
def sorted_json_text(spark, folder):
    """JS3 on whole texts."""
    members = {"text": F.col("text"), "lang": F.col("lang")}
    return table(spark, folder, "documents").select("doc_id", F.md5(sorted_json(members)).alias("digest"))


CHUNK_EVENTS = rf"""
raw AS (SELECT doc_id, text, CASE WHEN lang = 'en' THEN '' ELSE source END AS collection, source, lang, doc_id || '-0' AS event_id FROM documents),
chunk AS (SELECT *, coalesce(nullif(collection, ''), 'library') AS collection_name FROM raw),
k AS (SELECT *, 'doc_' || sha256(collection_name || '|' || {sql_part('source')} || '|unknown|unknown|'
  || CASE WHEN doc_id = 0 THEN 'unknown' ELSE doc_id::VARCHAR END || '|' || substr(sha256(text), 1, 16)) AS document_key FROM chunk),
v AS (SELECT *, 'vec_' || sha256(document_key) AS vector_id FROM k)
"""


def chunk_feed(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    fields = {
        "event_type": F.lit("index_chunk"), "collection_name": F.when(F.col("lang") == "en", "").otherwise(F.col("source")),
        "chunk_text": F.col("text"), "chunk_metadata": F.to_json(F.struct(F.col("source"), F.col("doc_id").alias("chunk_id"), F.col("lang").alias("trace_id"))),
    }
    entries = [c for name, col in fields.items() for c in (F.lit(name), col.cast("string").cast("binary"))]
    return docs.select(
        F.concat(F.col("doc_id").cast("string"), F.lit("-0")).alias("event_id"), at_seconds(F.col("doc_id")).alias("arrived_at"),
        F.create_map(*entries).alias("fields"),
    )


@report(f"""WITH {CHUNK_EVENTS} SELECT event_id, collection_name, 'chroma' AS backend, NULL::VARCHAR AS persist_directory, lang AS trace_id,
  source, document_key, vector_id, 'rag:idem:index_chunk:' || sha256('{{"collection_name": "' || collection_name || '", "document_key": "' || document_key
  || '", "vector_id": "' || vector_id || '"}}|' || vector_id) AS idempotency_key, NULL::VARCHAR AS screen, 7 AS entries FROM v""")
def chunk_event_fields(spark, folder):
    """PRJ6-PRJ8, FLT3, FLT4, KEY7, MAP5: typed, keyed and enriched chunk events."""
    prepared = prepared_chunks(E.chunk_events(chunk_feed(spark, folder), "library"))
    return prepared.select(
        "event_id", "collection_name", "backend", "persist_directory", F.col("event_trace").alias("trace_id"), "source",
        "document_key", "vector_id", "idempotency_key", "screen", F.size(F.json_object_keys("vector_metadata")).alias("entries"),
    )


@report(f"""WITH {CHUNK_EVENTS}, o AS (SELECT *, first_value(event_id) OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS holder FROM v)
  SELECT event_id, CASE WHEN holder = event_id THEN 'processed' ELSE 'retry' END AS disposition FROM o""")
def chunk_dispositions(spark, folder):
    """STR8: chunks whose text another document holds fail and are retried."""
    chunk_rows = ChunkFeed(spark, scratch_table(spark, "feed"), collection="library")
    chunk_rows.process(chunk_feed(spark, folder), 0)
    return chunk_rows.dispositions.current().select("event_id", "disposition")


@report(f"""WITH {CHUNK_EVENTS}, o AS (SELECT *, first_value(event_id) OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS holder FROM v)
  SELECT document_key, vector_id, source, lang AS trace_id, sha256(text) AS content_hash, 'mini' AS model, 64::INTEGER AS dimension, event_id
  FROM o WHERE holder = event_id""")
def chunk_feed_documents(spark, folder):
    """STR8, SNK3-5: the whole feed as one batch, down to stored documents and embeddings."""
    chunk_rows = ChunkFeed(spark, scratch_table(spark, "feed"), collection="library", model="mini", dimension=64)
    chunk_rows.process(chunk_feed(spark, folder), 0)
    embeddings = chunk_rows.embeddings.current().select(F.col("document_id").alias("id"), "vector_id", "model", "dimension", "idempotency_key")
    done = chunk_rows.ledger.versions().select("idempotency_key", "event_id")
    return chunk_rows.documents.current().drop("idempotency_key").join(embeddings, "id").join(done, "idempotency_key").select(
        "document_key", "vector_id", "source", "trace_id", "content_hash", "model", "dimension", "event_id"
    )


@report("""SELECT doc_id, lang AS source, 'library' AS collection_name, 'chroma' AS backend, '/data' AS persist_directory, NULL::VARCHAR AS no_directory FROM documents""")
def merged_metadata(spark, folder):
    """MAP3, MAP4, JS2: right-biased merge with an optional entry."""
    base = F.create_map(F.lit("source"), to_variant(F.col("source")), F.lit("backend"), to_variant(F.lit("old"))).cast(VARIANT_MAP)
    extra = {"source": F.col("lang"), "collection_name": F.lit("library"), "backend": F.lit("chroma")}
    with_dir = F.to_json(merge_metadata(base, extra, {"persist_directory": F.lit("/data")}))
    without = F.to_json(merge_metadata(base, extra, {"persist_directory": F.lit("")}))
    names = ("source", "collection_name", "backend", "persist_directory")
    return table(spark, folder, "documents").select(
        "doc_id", *[F.get_json_object(with_dir, f"$.{n}").alias(n) for n in names],
        F.get_json_object(without, "$.persist_directory").alias("no_directory"),
    )


@report("""SELECT user_id, max_by(CASE WHEN event_type = 'error' THEN -1 ELSE value END, event_id) AS raw, count(*) AS events FROM events GROUP BY 1""")
def last_writer(spark, folder):
    """AGG4: the last row wins, NULLs included (shown as -1)."""
    rows = table(spark, folder, "events").withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    last = rows.groupBy("user_id").agg(U.last_value(["v"], "event_id").alias("last"), F.count(F.lit(1)).alias("events"))
    return last.select("user_id", F.coalesce("last.v", F.lit(-1.0)).alias("raw"), "events")


@report("""SELECT user_id, max_by(value, event_id) FILTER (WHERE event_type <> 'error') AS value FROM events GROUP BY 1""")
def last_non_null(spark, folder):
    """AGG5."""
    rows = table(spark, folder, "events").withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    return rows.groupBy("user_id").agg(U.last_non_null("v", "event_id").alias("value"))


@report("""SELECT vec_id, coalesce(nullif(CASE WHEN label = 0 THEN '  ' ELSE ' mini-' || label || ' ' END, '  '), 'unknown') AS raw_model,
  CASE WHEN label = 0 THEN 'unknown' ELSE 'mini-' || label END AS model, len(embedding)::INTEGER AS dimension, 0::INTEGER AS missing FROM embeddings""")
def embedding_defaults(spark, folder):
    """EMB1, EMB2."""
    label = F.col("label")
    given = F.when(label == 0, "  ").otherwise(F.concat(F.lit(" mini-"), label.cast("string"), F.lit(" ")))
    return table(spark, folder, "embeddings").select(
        "vec_id", F.coalesce(F.nullif(given, F.lit("  ")), F.lit("unknown")).alias("raw_model"), K.embedding_model(given).alias("model"),
        K.embedding_dimension(F.lit(None).cast("int"), F.col("embedding")).alias("dimension"),
        K.embedding_dimension(F.lit(None).cast("int"), F.lit(None).cast("array<float>")).alias("missing"),
    )


# ---- the same operators with their groups cut, feeds over several batches ----

@report(SQL["surrogate_ids"])
def surrogate_ids_cut(spark, folder):
    """WIN3 with a split point for every 50 rows or so."""
    return ranking.surrogate_ids(durable(keyed(spark, folder).select("document_key"), "keys"), "document_key", every=50)


@report(SQL["message_upsert"])
def message_upsert_cut(spark, folder):
    """UPS2 and WIN1 with conversations cut at every other message or so."""
    rows = turns(spark, folder)
    merged = message_table(rows, conversation_table(rows), every=2)
    return merged.select("conversation_id", "message_id", "role", "text", "seq")


@report(SQL["ttl_marks"])
def ttl_marks_cut(spark, folder):
    """STR2 with every key cut into ranges of a few stamps."""
    rows = table(spark, folder, "events").select(
        F.concat_ws("/", "user_id", "event_type").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("now"), "event_id"
    )
    return dedup.first_seen(rows, "key", "now", "event_id", every=3).select("key", "event_id")


def thirds(events: DataFrame) -> list[DataFrame]:
    """A feed in three parts by time; together they are all of it."""
    lo, hi = events.agg(F.min("arrived_at"), F.max("arrived_at")).first()
    a, b = lo + (hi - lo) / 3, lo + (hi - lo) * 2 / 3
    at = F.col("arrived_at")
    return [events.where(at < F.lit(a)), events.where((at >= F.lit(a)) & (at < F.lit(b))), events.where(at >= F.lit(b))]


@report(SQL["ttl_marks"])
def ttl_marks_stream(spark, folder):
    """STR1, STR2 as keyed stream state: the events in time order over several micro-batches and a restart."""
    rows = table(spark, folder, "events").select(
        F.concat_ws("/", "user_id", "event_type").alias("key"), F.col("ts").cast("timestamp").alias("arrived_at"), "event_id"
    )
    source, sink, checkpoint = (scratch_table(spark, name) for name in ("feed", "marks", "progress"))
    first, *others = thirds(rows)
    for parts in ([first], others):
        for part in parts:
            part.write.mode("append").parquet(source)
        feed_rows = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 64).parquet(source)
        flagged = flag_repeats(feed_rows, "key", "arrived_at", "event_id")
        flagged.writeStream.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(sink).awaitTermination()
    return spark.read.parquet(sink).where("NOT repeat").select("key", "event_id")


@report(SQL["chat_feed_messages"])
def chat_feed_batches(spark, folder):
    """STR6, STR7, SNK1-2, SRC4: three batches, the first folded and the second replayed in between, equal one batch."""
    chat_rows = ChatFeed(spark, scratch_table(spark, "feed"))
    parts = thirds(repeated_turns(spark, folder))
    chat_rows.process(parts[0], 0)
    chat_rows.process(parts[1], 1)
    chat_rows.compact(0)
    chat_rows.process(parts[1], 1)
    chat_rows.process(parts[2], 2)
    sessions = chat_rows.conversations.current().select(F.col("id").alias("conversation_id"), "session_id")
    return chat_rows.messages.current().join(sessions, "conversation_id").select(
        "session_id", "role", "text", "seq", F.get_json_object("metadata", "$.redis_event_id").alias("redis_event_id")
    )


@report("""WITH e AS (SELECT event_id, ts FROM events WHERE event_type = 'error'), m AS (SELECT max(ts) AS t FROM e)
  SELECT event_id || '-0' AS original_event_id, '5' AS attempts, '''list'' object is not a mapping' AS error,
    CASE WHEN epoch_us(ts) + 172800000000 >= epoch_us(t) + 100000000 THEN 4 ELSE 5 END AS run FROM e, m""")
def redelivered_letters(spark, folder):
    """SRC4, STR3-5, SNK6: failing events reach the dead letters over runs without new input.

    A counter whose last failure is more than two days old starts anew.
    """
    rows = table(spark, folder, "events").where(F.col("event_type") == "error").withColumn("ts", F.col("ts").cast("timestamp"))
    texts = {"event_type": F.lit("qa_turn"), "session_id": F.lit("s"), "question": F.col("event_id").cast("string"), "user_metadata": F.lit("[1]")}
    entries = [c for name, col in texts.items() for c in (F.lit(name), col.cast("binary"))]
    events = rows.select(
        F.concat(F.col("event_id").cast("string"), F.lit("-0")).alias("event_id"), F.col("ts").alias("arrived_at"), F.create_map(*entries).alias("fields")
    )
    failing = ChatFeed(spark, scratch_table(spark, "feed"))
    failing.process(events, 0)
    last = events.agg(F.max("arrived_at")).first()[0]
    for run in range(1, 6):
        failing.redeliver(last + timedelta(seconds=100 * run))
    run = (F.unix_micros(F.col("failed_at").cast("timestamp")) - F.unix_micros(F.lit(last))) / 100_000_000
    return failing.letters.current().select("original_event_id", "attempts", "error", run.cast("int").alias("run"))


@report("""WITH f AS (SELECT user_id::VARCHAR AS event_id, epoch_us(ts) AS stamp FROM events WHERE event_type = 'error'),
  s AS (SELECT *, lead(stamp) OVER w AS next_at, CASE WHEN lag(stamp) OVER w + 172800000000 < stamp THEN 1 ELSE 0 END AS fresh
    FROM f WINDOW w AS (PARTITION BY event_id ORDER BY stamp)),
  g AS (SELECT *, sum(fresh) OVER (PARTITION BY event_id ORDER BY stamp ROWS UNBOUNDED PRECEDING) AS run FROM s),
  n AS (SELECT *, ((row_number() OVER (PARTITION BY event_id, run ORDER BY stamp) - 1) % 5 + 1)::INTEGER AS attempts FROM g),
  e AS (SELECT max(stamp) - 3600000000 AS t FROM f)
  SELECT event_id, attempts, 'dead_letter' AS disposition, stamp AS at_us FROM n WHERE attempts = 5
  UNION ALL SELECT event_id, attempts, 'retry', stamp + 60000000 FROM n, e WHERE attempts < 5 AND stamp + 60000000 < coalesce(next_at + 1, t)""")
def timed_retries(spark, folder):
    """STR3-5, SRC4 as keyed stream state: retries by timers over several micro-batches and a restart."""
    rows = table(spark, folder, "events").where(F.col("event_type") == "error").select(
        F.lit("s").alias("stream"), F.col("user_id").cast("string").alias("event_id"), F.col("ts").cast("timestamp").alias("arrived_at"),
        F.col("event_id").cast("string").alias("payload"),
    )
    source, sink, checkpoint = (scratch_table(spark, name) for name in ("feed", "retries", "progress"))
    first, *others = thirds(rows)
    for parts in ([first], others):
        for part in parts:
            part.write.mode("append").parquet(source)
        failures = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 64).parquet(source).withColumnRenamed("arrived_at", "failed_at")
        routed_rows = route_by_timers(failures)
        routed_rows.writeStream.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(sink).awaitTermination()
    return spark.read.parquet(sink).select("event_id", "attempts", "disposition", F.unix_micros("at").alias("at_us"))


# Events in a file of a raw feed at most, so that its readers are dealt to all cores.
RAW_PER_FILE = 100_000


def raw_files(events: DataFrame, path: str) -> None:
    """A feed as its producers write it: ids and field names as bytes, each with a byte that is no text."""
    stray = F.unhex(F.lit("FF"))
    names = F.transform(F.map_entries("fields"), lambda e: F.struct(F.concat(e["key"].cast("binary"), stray).alias("key"), e["value"].alias("value")))
    events.select(
        F.concat(stray, F.col("event_id").cast("binary")).alias("event_id"), "arrived_at", F.map_from_entries(names).alias("fields")
    ).write.option("maxRecordsPerFile", RAW_PER_FILE).parquet(path)


@report(SQL["chat_feed_messages"])
def streamed_messages(spark, folder):
    """SRC1, SRC5, SRT2, PRJ1, KEY9: a stream over files of raw events, at most a third of them handled at once, equals one batch."""
    events = repeated_turns(spark, folder)
    path, checkpoint = scratch_table(spark, "raw"), scratch_table(spark, "progress")
    raw_files(events, path)
    chat_rows = ChatFeed(spark, scratch_table(spark, "feed"), max_events=events.count() // 3 + 1)
    first = events.agg(F.min("arrived_at")).first()[0]
    chat_rows.start(path, checkpoint, now=first).awaitTermination()
    sessions = chat_rows.conversations.current().select(F.col("id").alias("conversation_id"), "session_id")
    return chat_rows.messages.current().join(sessions, "conversation_id").select(
        "session_id", "role", "text", "seq", F.get_json_object("metadata", "$.redis_event_id").alias("redis_event_id")
    )


@report("""SELECT event_id || '-0' AS event_id, event_type, (row_number() OVER (ORDER BY ts, event_id) - 1) // 1000 AS slice FROM events""")
def admitted_slices(spark, folder):
    """SRT2, KEY9, PRJ1: raw events in slices of a thousand, in arrival order, the numbering cut at about every 300th event."""
    path = scratch_table(spark, "raw")
    raw_files(feed(spark, folder, event_type=F.col("event_type")), path)
    events = durable(E.read_events(spark, path), "events")
    sliced = E.numbered_slices(events, 1000, every=300)
    return sliced.select("event_id", F.col("fields")["event_type"].cast("string").alias("event_type"), "slice")


def ragged_feed(spark: SparkSession, folder: str) -> DataFrame:
    """Clicks of a user share an event id, views have none; a stray byte in each session, a repeated JSON key."""
    kind, own = F.col("event_type"), F.col("event_id").cast("string")
    session = F.concat(F.concat(F.lit("u"), F.col("user_id")).cast("binary"), F.unhex(F.lit("FF")))
    texts = {
        "event_type": F.lit("qa_turn").cast("binary"), "session_id": session, "question": own.cast("binary"),
        "user_metadata": F.concat(F.lit('{"k": 0, "k": '), F.get_json_object("props", "$.k"), F.lit("}")).cast("binary"),
    }
    given = F.when(kind == "click", F.concat(F.lit("c"), F.col("user_id"))).when(kind != "view", F.concat(own, F.lit("-0")))
    return table(spark, folder, "events").select(
        given.alias("event_id"), F.col("ts").cast("timestamp").alias("arrived_at"),
        F.create_map(*[c for name, col in texts.items() for c in (F.lit(name), col)]).alias("fields"),
    )


@report("""WITH c AS (SELECT count(*) - count(DISTINCT user_id) AS again FROM events WHERE event_type = 'click')
  SELECT 'repeated_id' AS disposition, again AS events FROM c UNION ALL SELECT 'processed', (SELECT count(*) FROM events) - again FROM c""")
def ragged_dispositions(spark, folder):
    """AGG1, SRC1: every row of a feed gets an outcome, also with repeated and missing ids."""
    feed_rows = ChatFeed(spark, scratch_table(spark, "feed"))
    feed_rows.process(ragged_feed(spark, folder), 0)
    return feed_rows.dispositions.versions().groupBy("disposition").agg(F.count(F.lit(1)).alias("events"))


@report("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'click'),
  e AS (SELECT event_id, user_id, props FROM f WHERE n = 1 UNION ALL SELECT event_id, user_id, props FROM events WHERE event_type <> 'click')
  SELECT event_id::VARCHAR AS question, 'u' || user_id AS session_id, (props->>'k')::INTEGER AS k FROM e""")
def ragged_messages(spark, folder):
    """PRJ2, PRJ4, JS1: invalid bytes go, the last of repeated JSON keys stays, the first of equal ids is stored."""
    feed_rows = ChatFeed(spark, scratch_table(spark, "feed"))
    feed_rows.process(ragged_feed(spark, folder), 0)
    sessions = feed_rows.conversations.current().select(F.col("id").alias("conversation_id"), "session_id")
    return feed_rows.messages.current().where("role = 'user'").join(sessions, "conversation_id").select(
        F.col("text").alias("question"), "session_id", F.get_json_object("metadata", "$.k").cast("int").alias("k")
    )


def sized(rows: DataFrame) -> DataFrame:
    """A deterministic embedder: the text's length, and one."""

    # Defined here so that workers get it by value.
    class Lengths:
        def embed_query(self, text: str) -> list[float]:
            return [float(len(text)), 1.0]

    return rows.withColumn("embedding", embed_column(Lengths, F.col("page_content")))


@report(f"""WITH {CHUNK_EVENTS}, o AS (SELECT *, first_value(event_id) OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS holder FROM v)
  SELECT document_key, 2::INTEGER AS dimension, 2::INTEGER AS size, length(text)::DOUBLE AS first, collection_name, lang AS trace_id FROM o WHERE holder = event_id""")
def embedded_chunks(spark, folder):
    """UDF1, EMB2, MAP6: the stored dimension is the length of the vector that the embedder made."""
    chunk_rows = ChunkFeed(spark, scratch_table(spark, "feed"), collection="library", embed=sized)
    chunk_rows.process(chunk_feed(spark, folder), 0)
    vectors = chunk_rows.vectors.current().select("vector_id", "embedding")
    get = lambda n: F.get_json_object("metadata", f"$.{n}").alias(n)
    return chunk_rows.embeddings.current().join(vectors, "vector_id").select(
        get("document_key"), "dimension", F.size("embedding").alias("size"), F.get("embedding", F.lit(0)).cast("double").alias("first"),
        get("collection_name"), get("trace_id"),
    )


def picky(rows: DataFrame) -> DataFrame:
    """An embedder that refuses texts whose length is a multiple of seven, and every batch that holds one."""

    class Picky:
        def embed_query(self, text: str) -> list[float]:
            if len(text) % 7 == 0:
                raise ValueError(f"no vector for {len(text)} characters")
            return [float(len(text)), 1.0]

        def embed_documents(self, texts: list[str]) -> list[list[float]]:
            return [self.embed_query(t) for t in texts]

    return rows.withColumn("embedding", embed_texts(Picky, F.col("page_content")))


@report(f"""WITH {CHUNK_EVENTS}, o AS (SELECT *, length(text) % 7 = 0 AS failing, first_value(event_id) OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS holder FROM v)
  SELECT event_id, CASE WHEN failing OR holder <> event_id THEN 'dead_letter' ELSE 'stored' END AS outcome,
    CASE WHEN failing OR holder <> event_id THEN '3' END AS attempts, CASE WHEN NOT failing AND holder = event_id THEN length(text)::DOUBLE END AS first,
    CASE WHEN failing THEN 'no vector for ' || length(text) || ' characters' WHEN holder <> event_id THEN 'Failed to persist document ' || document_key END AS error
  FROM o""")
def failing_embeddings(spark, folder):
    """UDF1, STR3-5, STR8: every text that cannot be embedded fails alone, through its retries to the dead letters; all others are stored once."""
    chunk_rows = ChunkFeed(spark, scratch_table(spark, "feed"), collection="library", embed=picky, max_retries=3)
    events = chunk_feed(spark, folder)
    chunk_rows.process(events, 0)
    # A counter that is older than its TTL starts anew, so a long feed needs more runs than a text has retries.
    now = events.agg(F.max("arrived_at")).first()[0]
    while not chunk_rows.attempts.current().where("attempts > 0").isEmpty():
        now += timedelta(seconds=100)
        chunk_rows.redeliver(now)
    none = F.lit(None)
    vectors = chunk_rows.vectors.current().select("vector_id", F.get("embedding", F.lit(0)).cast("double").alias("first"))
    stored = chunk_rows.embeddings.current().join(vectors, "vector_id").join(chunk_rows.ledger.versions().select("idempotency_key", "event_id"), "idempotency_key")
    dead = chunk_rows.letters.current()
    return stored.select("event_id", F.lit("stored").alias("outcome"), none.cast("string").alias("attempts"), "first", none.cast("string").alias("error")).unionByName(
        dead.select(F.col("original_event_id").alias("event_id"), F.lit("dead_letter").alias("outcome"), "attempts", none.cast("double").alias("first"), "error")
    )


@report(f"""WITH {DOCS} SELECT document_key, 2::INTEGER AS dimension, 'library' AS collection_name, 'chroma' AS backend, NULL::VARCHAR AS persist_directory,
  4::INTEGER AS entries FROM accepted""")
def ingested_embeddings(spark, folder):
    """UPS6, MAP4, EMB2: batch ingest with an embedder."""
    done = ingest.persist_chunks(chunks(spark, folder), collection="library", bound=True, embed=sized)
    get = lambda n: F.get_json_object("metadata", f"$.{n}").alias(n)
    return done.embeddings.select(
        get("document_key"), "dimension", get("collection_name"), get("backend"), get("persist_directory"),
        F.size(F.json_object_keys("metadata")).alias("entries"),
    )


@report(f"""WITH {DOCS} SELECT id, document_key, source, lang AS title_path, content_hash, length(text) AS chars, 'vec_' || sha256(document_key) AS vector_id,
  'm' AS model, 64::INTEGER AS dimension, 11::INTEGER AS document_columns, 10::INTEGER AS embedding_columns FROM accepted WHERE lang = 'en'""")
def read_back(spark, folder):
    """PRJ9: stored documents and embeddings read back by their keys; keys that were refused list nothing."""
    done = ingest.persist_chunks(chunks(spark, folder), collection="library", model="m", dimension=64, bound=True)
    wanted = keyed(spark, folder).where(F.col("title_path") == "en").select("document_key", "vector_id")
    documents = history.stored_documents(done.documents, wanted)
    embeddings = history.stored_embeddings(done.embeddings, wanted)
    return documents.select("id", "document_key", "source", "title_path", "content_hash", F.char_length("content").cast("long").alias("chars")).join(
        embeddings.select(F.col("document_id").alias("id"), "vector_id", "model", "dimension"), "id"
    ).withColumns({"document_columns": F.lit(len(documents.columns)), "embedding_columns": F.lit(len(embeddings.columns))})


@report("""SELECT doc_id || '-0' AS event_id, CASE WHEN lang <> 'en' THEN 'skipped_type' WHEN source = 'src0' THEN 'skipped_empty' END AS screen FROM documents""")
def chunk_screens(spark, folder):
    """FLT3, FLT4, FLT5: the type is checked before the text; no fields at all are no chunk."""
    docs = table(spark, folder, "documents")
    fields = F.create_map(
        F.lit("event_type"), F.when(F.col("lang") == "en", "index_chunk").otherwise("other").cast("binary"),
        F.lit("chunk_text"), F.when(F.col("source") == "src0", "").otherwise(F.col("text")).cast("binary"),
    )
    events = docs.select(
        F.concat(F.col("doc_id").cast("string"), F.lit("-0")).alias("event_id"), at_seconds(F.col("doc_id")).alias("arrived_at"),
        F.when(F.col("lang") != "de", fields).alias("fields"),
    )
    return E.chunk_events(events).select("event_id", E.chunk_screen().alias("screen"))


@report(f"WITH {DOCS} SELECT 'vec_' || sha256(document_key) AS vector_id, id AS document_id, 'twice' AS model FROM accepted")
def vectors_again(spark, folder):
    """UPS4: a vector that comes a second time is overwritten and its document stays."""
    docs = U.upsert_documents(None, keyed(spark, folder), bound=True).rows.select("id", "document_key")
    rows = durable(U.document_ids(keyed(spark, folder).select("document_key", "vector_id", "ord", "at"), docs), "vectors")
    none = [F.lit(None).cast("string").alias(c) for c in ("trace_id", "idempotency_key", "metadata")]
    once = rows.select("document_id", "vector_id", "ord", "at", F.lit("once").alias("model"), F.lit(1).alias("dimension"), *none)
    again = once.withColumns({"model": F.lit("twice"), "document_id": F.lit(-1).cast("long"), "ord": F.col("ord") + 10_000_000})
    return U.upsert_embeddings(None, once.unionByName(again), bound=True).rows.select("vector_id", "document_id", "model")


@report(f"""WITH {TURNS}, {CONVS} SELECT t.message_id, t.session_id FROM turns t WHERE t.role = 'system'""")
def message_orphans(spark, folder):
    """JN7 on a declared reference: messages of conversations that are not stored."""
    rows = turns(spark, folder)
    conversations = conversation_table(rows)
    merged = message_table(rows, conversations)
    lost = merged.withColumn("conversation_id", F.when(F.col("role") == "system", -F.col("conversation_id")).otherwise(F.col("conversation_id")))
    back = conversations.select(F.col("id").alias("conversation_id"), "session_id")
    orphaned = audit.orphans(lost, conversations, "conversation_id", "id")
    return orphaned.withColumn("conversation_id", -F.col("conversation_id")).join(back, "conversation_id").select("message_id", "session_id")
