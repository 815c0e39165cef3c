import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerflow import schema
from ledgerflow.operators import audit, dedup, history, ranking, retry
from ledgerflow.operators import upsert as U
from ledgerflow.operators.claims import first_claims, resolve_claims

DAY0 = datetime(2024, 1, 1)
DOCS = "document_key string, content_hash string, idempotency_key string"


@pytest.mark.parametrize("every", [3, 50, 2_000_000])
def test_grouped_rank_with_a_hot_group(spark, every):
    rnd = random.Random(every)
    orders = rnd.sample(range(10_000), 600)
    rows = [("hot" if i % 3 == 0 else f"k{o % 40}", o) for i, o in enumerate(orders)]
    df = spark.createDataFrame(rows, "k string, o long")
    got = {(r.k, r.o): r.n for r in ranking.grouped_rank(df, ["k"], "o", "n", every).collect()}
    groups = {}
    for k, o in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(k, []).append(o)
    assert got == {(k, o): i + 1 for k, os in groups.items() for i, o in enumerate(os)}


def test_surrogate_ids_continue(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in range(200)], "k string")
    taken = spark.createDataFrame([(41,), (7,)], "id long")
    got = {r.k: r.id for r in ranking.surrogate_ids(df, "k", taken=taken, every=10).collect()}
    assert got == {k: i + 42 for i, k in enumerate(sorted(f"k{i}" for i in range(200)))}


def greedy(rows, stored):
    held, out = dict(stored), {}
    for order, key, h, i in rows:
        clash = any(k != key and (v[0] == h or (i is not None and v[1] == i)) for k, v in held.items())
        if not clash:
            held[key] = (h, i)
        out[order] = not clash
    return out


@pytest.mark.parametrize("seed,n,keys", [(1, 60, 12), (2, 150, 140), (3, 100, 60)])
def test_resolve_claims_equals_one_by_one(spark, seed, n, keys):
    rnd = random.Random(seed)
    rows = [
        (o, f"k{rnd.randrange(keys)}", f"h{int(rnd.random() ** 3 * keys)}", rnd.choice([None, f"i{rnd.randrange(2 * keys)}"]))
        for o in range(n)
    ]
    stored = {f"k{j}": (f"h{j}", f"i{j}") for j in range(0, keys, 7)}
    incoming = spark.createDataFrame(rows, "ord long, " + DOCS)
    existing = spark.createDataFrame([(k, *v) for k, v in stored.items()], DOCS)
    got = resolve_claims(incoming, existing, "document_key", ["content_hash", "idempotency_key"], "ord")
    assert {r.ord: r.accepted for r in got.collect()} == greedy(rows, stored)


def test_hot_value_is_settled_in_few_waves(spark):
    rows = [(o, f"k{o}", "same" if o % 3 else f"h{o}", None) for o in range(300)]
    incoming = spark.createDataFrame(rows, "ord long, " + DOCS)
    waves = resolve_claims(incoming, None, "document_key", ["content_hash", "idempotency_key"], "ord")
    assert {r.ord: r.accepted for r in waves.collect()} == greedy(rows, {})
    direct = first_claims(incoming, None, "document_key", "content_hash", "ord")
    assert {r.ord: r.accepted for r in direct.collect()} == greedy(rows, {})


def kept_one_by_one(rows, ttl):
    last, out = {}, set()
    for key, now, order in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in last or now > last[key] + ttl:
            last[key] = now
            out.add(order)
    return out


@pytest.mark.parametrize("every,span,ttl", [(2_000_000, 100, 10), (7, 100, 10), (20, 1000, 50), (5, 60, 3)])
def test_ttl_rule_with_hot_keys(spark, every, span, ttl):
    rnd = random.Random(every)
    rows = [("hot" if o % 2 else f"k{o % 9}", rnd.randrange(span * 1_000_000), o) for o in range(900)]
    df = spark.createDataFrame(rows, "k string, now long, o long")
    got = {r.o for r in dedup.first_seen(df, "k", "now", "o", ttl, every=every).collect()}
    assert got == kept_one_by_one(rows, ttl * 1_000_000)


def settle(spark, rows, ledger=None, ttl=10):
    data = [(k, DAY0 + timedelta(seconds=s), o, v) for o, (k, s, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "idempotency_key string, arrived_at timestamp, ord long, valid boolean")
    if ledger is not None:
        ledger = spark.createDataFrame([(k, "e", DAY0 + timedelta(seconds=s)) for k, s in ledger], schema.LEDGER)
    out = dedup.settle(df, ledger, ttl).collect()
    assert len(out) == len(rows)
    return [r.repeat for r in sorted(out, key=lambda r: r.ord)]


def test_settle_edges(spark):
    # exactly at the TTL is a repeat, just after is not, and a repeat does not prolong
    assert settle(spark, [("a", 0, True), ("a", 10, True), ("a", 11, True)]) == [False, True, False]
    # a failing first row does not claim the key, a failing later one is a repeat
    assert settle(spark, [("a", 0, False), ("a", 1, True), ("a", 2, False)]) == [False, False, True]
    # same instant: the earlier row in order sets the mark
    assert settle(spark, [("a", 0, False), ("a", 0, True), ("a", 0, True)]) == [False, False, True]
    # ledger marks, expired and live, and a row that arrives late
    assert settle(spark, [("a", 20, True), ("b", 20, True), ("c", 1, True)], [("a", 5), ("b", 10), ("c", 8)]) == [False, True, True]


def test_drop_processed(spark):
    now = F.lit(DAY0 + timedelta(days=7))
    ledger = spark.createDataFrame([("a", "e", DAY0), ("b", "e", DAY0 - timedelta(seconds=1))], schema.LEDGER)
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "idempotency_key string")
    assert sorted(r[0] for r in dedup.drop_processed(rows, ledger, now).collect()) == ["b", "c"]


CONV = "session_id string, user_id string, title string, ord long, at timestamp"
MSG = "conversation_id long, message_id string, role string, text string, trace_id string, idempotency_key string, metadata string, ord long, at timestamp"
DOC = "document_key string, content string, source string, title_path string, trace_id string, idempotency_key string, metadata string, ord long, at timestamp"


def test_conversations_keep_what_is_not_null(spark):
    first = U.upsert_conversations(None, spark.createDataFrame([("s", "u", "T", 1, DAY0), ("r", None, None, 0, DAY0)], CONV))
    later = DAY0 + timedelta(hours=1)
    second = U.upsert_conversations(first, spark.createDataFrame([("s", None, None, 2, later), ("q", "v", None, 3, later)], CONV))
    got = {r.session_id: (r.id, r.user_id, r.title, r.created_at, r.updated_at) for r in second.collect()}
    assert got == {
        "r": (1, None, None, DAY0, DAY0), "s": (2, "u", "T", DAY0, later), "q": (3, "v", None, later, later),
    }
    assert second.schema.names == schema.CONVERSATIONS.struct.names


def test_messages_keep_conversation_and_sequence(spark):
    m = lambda c, i, text, meta, o: (c, i, "user", text, None, None, meta, o, DAY0)
    first = U.upsert_messages(None, spark.createDataFrame([m(1, "a", "1", "{}", 0), m(1, "b", "2", "{}", 1), m(2, "a", "3", None, 2)], MSG))
    got = {r.message_id: (r.conversation_id, r.seq, r.text, r.metadata) for r in first.collect()}
    assert got == {"a": (1, 1, "3", None), "b": (1, 2, "2", "{}")}
    second = U.upsert_messages(first, spark.createDataFrame([m(2, "b", "9", None, 5), m(1, "c", "x", None, 6)], MSG), touched_only=True)
    got = {r.message_id: (r.id, r.conversation_id, r.seq, r.text) for r in second.collect()}
    assert got == {"b": (2, 1, 2, "9"), "c": (3, 1, 3, "x")}


def doc(key, content, idem, order, source=None):
    return (key, content, source, None, None, idem, None, order, DAY0)


def test_documents_refuse_held_content_and_keys(spark):
    rows = [doc("a", "x", None, 0), doc("b", "x", None, 1), doc("a", "x", "i", 2, "src"), doc("c", "z", "i", 3), doc("d", "w", "j", 4)]
    merged = U.upsert_documents(None, spark.createDataFrame(rows, DOC))
    assert {r.document_key: (r.id, r.source) for r in merged.rows.collect()} == {"a": (1, "src"), "d": (2, None)}
    assert {r.document_key: r.error for r in merged.rejected.collect()} == {
        "b": "Failed to persist document b", "c": "Failed to persist document c"}
    # new content for a stored key frees its old content
    again = U.upsert_documents(merged.rows, spark.createDataFrame([doc("e", "x", None, 5), doc("a", "y", None, 6), doc("f", "x", None, 7)], DOC))
    assert {r.document_key: r.content for r in again.rows.collect()} == {"a": "y", "d": "w", "f": "x"}


def test_embeddings_keep_their_document(spark):
    schema_ = "document_id long, vector_id string, model string, dimension int, trace_id string, idempotency_key string, metadata string, ord long, at timestamp"
    rows = [(1, "v", "m", 3, None, "i", None, 0, DAY0), (2, "v", "n", 4, None, "i", None, 1, DAY0), (3, "w", "m", 3, None, "i", None, 2, DAY0)]
    merged = U.upsert_embeddings(None, spark.createDataFrame(rows, schema_))
    assert [(r.document_id, r.vector_id, r.model, r.dimension) for r in merged.rows.collect()] == [(1, "v", "n", 4)]
    assert [r.error for r in merged.rejected.collect()] == ["Failed to persist embedding w"]


def test_vectors_last_write_wins(spark):
    cols = "vector_id string, page_content string, metadata string, embedding array<float>, ord long"
    first = U.upsert_vectors(None, spark.createDataFrame([("v", "1", None, None, 0), ("v", "2", None, [1.0], 1), ("w", "3", None, None, 2)], cols))
    second = U.upsert_vectors(first, spark.createDataFrame([("w", "4", None, None, 3)], cols))
    assert {r.vector_id: r.page_content for r in second.collect()} == {"v": "2", "w": "4"}


def test_turns_without_ids_get_stable_ones(spark):
    cols = ("session_id string, user_text string, assistant_text string, user_message_id string, assistant_message_id string, trace_id string,"
            " idempotency_key string, user_metadata string, assistant_metadata string, ord long, at timestamp")
    turns = spark.createDataFrame([("s", "q", "a", "", None, None, "k", None, None, 0, DAY0)], cols)
    one, two = U.record_turns(turns).collect(), U.record_turns(turns).collect()
    assert one == two and len({r.message_id for r in one}) == 2 and all(len(r.message_id) == 32 for r in one)


def test_failure_routes(spark):
    failed = spark.createDataFrame([("s", "e", DAY0)], "stream string, event_id string, failed_at timestamp")
    for prior, age, want in [(0, 0, ("retry", 1, 1.0)), (1, 1, ("retry", 2, 2.0)), (3, 2, ("retry", 4, 8.0)), (4, 2, ("dead_letter", 5, None)), (4, 3, ("retry", 1, 1.0))]:
        stored = spark.createDataFrame([("s", "e", prior, DAY0 - timedelta(days=age), None)], schema.ATTEMPTS)
        row = retry.route_failures(retry.count_failures(failed, stored)).first()
        assert (row.disposition, row.attempts, row.backoff_seconds) == want
        if want[0] == "retry":
            assert row.next_attempt_at == DAY0 + timedelta(seconds=60)
    assert retry.due_retries(stored.withColumn("next_attempt_at", F.lit(DAY0)), F.lit(DAY0), 1).count() == 1


def test_history_and_cascade(spark):
    conversations = spark.createDataFrame([(1, "s"), (2, "t")], "id long, session_id string")
    rows = [(1, f"m{i}", "user" if i % 2 else "assistant", f"x{i}", i, None, DAY0) for i in range(1, 6)]
    messages = spark.createDataFrame(rows, "conversation_id long, message_id string, role string, text string, seq int, metadata string, created_at timestamp")
    for limit, want in [(2, [1, 2]), (5, [1, 2, 3, 4, 5]), (9, [1, 2, 3, 4, 5])]:
        assert [r.seq for r in history.session_messages(conversations, messages, "s", limit).collect()] == want
    assert history.session_messages(conversations, messages, "nobody").count() == 0
    assert history.session_messages(conversations, messages, "t").count() == 0
    assert sorted(r.seq for r in history.history_pages(conversations, messages, 3).collect()) == [1, 2, 3]
    assert {(r.question, r.answer) for r in history.turn_pairs(messages).collect()} == {("x1", "x2"), ("x3", "x4")}
    kept, removed = history.cascade_delete(messages, conversations.where("id = 1"), "conversation_id")
    assert (kept.count(), removed.count()) == (0, 5)


def test_audits(spark):
    rows = spark.createDataFrame([("s1", "u" * 129), ("s1", None), (None, "u")], "session_id string, user_id string")
    got = {r.column: (r.nulls, r.too_long) for r in audit.column_audit(rows, schema.CONVERSATIONS).collect()}
    assert got == {"session_id": (1, 0), "user_id": (0, 1)}
    assert [tuple(r) for r in audit.uniqueness_audit(rows, schema.CONVERSATIONS).collect()] == [("session_id", 1, 2)]
    parents = spark.createDataFrame([(1,)], "id long")
    child = spark.createDataFrame([(1,), (2,)], "conversation_id long")
    assert [r[0] for r in audit.orphans(child, parents, "conversation_id").collect()] == [2]


def test_stored_rows_by_key(spark):
    """Repeated, unknown and NULL keys; other columns of either side do not matter."""
    names = [f.name for f in schema.EMBEDDINGS.struct]
    stored = spark.range(4).select(*[
        F.col("id") if n == "id" else F.concat(F.lit("v"), "id").alias(n) if n == "vector_id" else F.lit(None).cast("string").alias(n) for n in reversed(names)
    ]).withColumn("extra", F.lit(1))
    keys = spark.createDataFrame([("v1", 9), ("v1", 8), ("v3", 7), ("v7", 6), (None, 5)], "vector_id string, id long")
    found = history.stored_embeddings(stored, keys)
    assert found.columns == names
    assert sorted(r.vector_id for r in found.collect()) == ["v1", "v3"]
    assert history.stored_embeddings(stored, keys.limit(0)).isEmpty()
