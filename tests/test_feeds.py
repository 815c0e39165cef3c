import json
import os
import random
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerflow import schema
from ledgerflow.session import ensure_checkpoint_dir
from ledgerflow.sources import events as E
from ledgerflow.sources.tables import TableLog
from ledgerflow.streaming.feeds import ChatFeed, ChunkFeed

DAY0 = datetime(2024, 1, 1)


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def event(number, seconds, **fields):
    return (f"{number}-0", DAY0 + timedelta(seconds=seconds), {k: v.encode() for k, v in fields.items()})


def frame(spark, rows):
    return spark.createDataFrame(rows, schema.EVENT)


def turn(number, seconds, question, **fields):
    return event(number, seconds, event_type="qa_turn", session_id="s1", question=question, answer=question.upper(), **fields)


def outcomes(feed):
    rows = feed.dispositions.versions().orderBy("batch_id").collect()
    return {(r.batch_id, r.event_id): r.disposition for r in rows if r.disposition != "repeated_id"}


FIRST = [
    turn(9, 0, "a", conversation_title="T"), turn(10, 1, "a"), turn(11, 2, "c", user_metadata="[1]"), event(12, 3, event_type="other"),
    event(13, 4, event_type="qa_turn", question="z"), turn(14, 5, "e", user_metadata='{"k": 1}', snapshot='[{"x": 2}]', trace_id="t"),
    ("15-0", DAY0, None),
]


def test_chat_feed_with_retries_and_replay(spark, root):
    feed = ChatFeed(spark, root, max_retries=2)
    feed.process(frame(spark, FIRST), 0)
    assert outcomes(feed) == {
        (0, "9-0"): "processed", (0, "10-0"): "duplicate", (0, "11-0"): "retry", (0, "12-0"): "skipped_type",
        (0, "13-0"): "skipped_empty", (0, "14-0"): "processed", (0, "15-0"): "skipped_type",
    }
    # The retry is not due after 30 s, and is dead-lettered with the batch at 100 s.
    feed.process(frame(spark, [turn(16, 32, "a")]), 1)
    second = frame(spark, [turn(17, 100, "g"), turn(17, 100, "g")])
    feed.process(second, 2)
    assert {k: v for k, v in outcomes(feed).items() if k[0]} == {
        (1, "16-0"): "duplicate", (2, "11-0"): "dead_letter", (2, "17-0"): "processed"}
    letter = feed.letters.current().first()
    assert (letter.original_event_id, letter.attempts, letter.trace_id, letter.dlq_stream) == ("11-0", "2", "", "rag:events:dlq")
    assert letter.error == "'list' object is not a mapping" and letter.failed_at == "2024-01-01T00:01:40+00:00"
    assert json.loads(letter.payload)["user_metadata"] == [1]
    assert feed.attempts.current().first().attempts == 0
    assert feed.processed_count() == 3

    def tables():
        logs = (feed.conversations, feed.messages, feed.ledger, feed.attempts, feed.letters, feed.dispositions)
        return [sorted(map(str, log.current().collect())) for log in logs]

    before = tables()
    feed.process(second.repartition(5), 2)
    assert tables() == before
    messages = {r.seq: r for r in feed.messages.current().collect()}
    assert [messages[i].text for i in range(1, 7)] == ["a", "A", "e", "E", "g", "G"]
    assert sorted(m.id for m in messages.values()) == [1, 2, 3, 4, 5, 6]
    meta = json.loads(messages[4].metadata)
    assert meta == {"redis_event_id": "14-0", "trace_id": "t", "idempotency_key": messages[4].idempotency_key, "snapshot": [{"x": 2}]}
    assert json.loads(messages[3].metadata)["k"] == 1
    assert feed.conversations.current().first().title == "T"
    with pytest.raises(ValueError):
        feed.compact(2)
    feed.compact(1)
    feed.process(second, 2)
    assert tables() == before


def test_stream_restart(spark, root):
    def arrive(rows):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(f"{root}/in")

    arrive([turn(1, 0, "a")])
    feed = ChatFeed(spark, f"{root}/out")
    feed.start(f"{root}/in", f"{root}/ck").awaitTermination()
    arrive([turn(2, 1, "a"), turn(3, 2, "b")])
    feed = ChatFeed(spark, f"{root}/out")
    feed.start(f"{root}/in", f"{root}/ck", max_files=1).awaitTermination()
    assert outcomes(feed) == {(0, "1-0"): "processed", (1, "2-0"): "duplicate", (1, "3-0"): "processed"}
    assert sorted(r.seq for r in feed.messages.current().collect()) == [1, 2, 3, 4]


def chunk(number, seconds, text, **fields):
    meta = fields.pop("meta", {})
    return event(number, seconds, event_type="index_chunk", chunk_text=text, chunk_metadata=meta if isinstance(meta, str) else json.dumps(meta), **fields)


def test_chunk_feed(spark, root):
    def embed(rows):
        return rows.withColumn("embedding", F.array(F.lit(0.0).cast("float"), F.lit(1.0).cast("float")))

    feed = ChunkFeed(spark, root, collection="lib", model="m", dimension=2, embed=embed)
    feed.process(frame(spark, [
        chunk(1, 0, "x", meta={"source": "A", "trace_id": "t"}), chunk(2, 1, "x", meta={"source": "B"}), chunk(3, 2, "x", meta={"source": "A"}),
        chunk(4, 3, "", meta={}), chunk(5, 4, "y", meta="[1]"), chunk(6, 5, "z", meta="null", idempotency_key="k", collection_name="other"),
    ]), 0)
    assert outcomes(feed) == {
        (0, "1-0"): "processed", (0, "2-0"): "retry", (0, "3-0"): "duplicate", (0, "4-0"): "skipped_empty", (0, "5-0"): "retry", (0, "6-0"): "processed"}
    documents = {r.content: r for r in feed.documents.current().collect()}
    assert set(documents) == {"x", "z"} and documents["x"].source == "A" and documents["x"].trace_id == "t" and documents["z"].idempotency_key == "k"
    assert json.loads(documents["z"].metadata)["collection_name"] == "other"
    embeddings = {r.document_id: r for r in feed.embeddings.current().collect()}
    assert {d.id for d in documents.values()} == set(embeddings) and {(e.model, e.dimension) for e in embeddings.values()} == {("m", 2)}
    vectors = {r.vector_id: r for r in feed.vectors.current().collect()}
    assert len(vectors) == 3 and set(e.vector_id for e in embeddings.values()) < set(vectors)
    assert all(v.embedding == [0.0, 1.0] for v in vectors.values())
    feed.process(frame(spark, [chunk(7, 10, "z", meta={"source": "C"}, idempotency_key="k2"), chunk(8, 11, "w", idempotency_key="k")]), 1)
    assert {k[1]: v for k, v in outcomes(feed).items() if k[0] == 1} == {"7-0": "retry", "8-0": "duplicate"}


def one_by_one(rows, keys, ttl):
    """Sequential handling of chunk events: ledger, then unique keys, then mark."""
    marks, held, out = {}, {}, {}
    for number, seconds, text, source, idem in rows:
        doc = keys[(text, source)]
        if idem in marks and marks[idem] + ttl >= seconds:
            out[f"{number}-0"] = "duplicate"
        elif any(k != doc and text_ == text or k != doc and i == idem for k, (text_, i) in held.items()):
            out[f"{number}-0"] = "retry"
        else:
            held[doc], marks[idem], out[f"{number}-0"] = (text, idem), seconds, "processed"
    return out


def test_chunk_feed_equals_one_by_one_with_shared_keys(spark, root):
    rnd = random.Random(4)
    rows = [(n, 3 * n, f"t{rnd.randrange(8)}", f"s{rnd.randrange(2)}", f"k{rnd.randrange(9)}") for n in range(1, 50)]
    feed = ChunkFeed(spark, root, ttl_seconds=20)
    feed.process(frame(spark, [chunk(n, s, t, meta={"source": src}, idempotency_key=k) for n, s, t, src, k in rows]), 0)
    keys = {(t, s): (t, s) for _, _, t, s, _ in rows}
    want = one_by_one(rows, keys, 20)
    assert {k[1]: v for k, v in outcomes(feed).items()} == want
    assert set(want.values()) == {"processed", "duplicate", "retry"}


def test_event_order_is_numeric(spark):
    rows = frame(spark, [event(10, 0), event(9, 0), ("9-10", DAY0, {}), ("9-9", DAY0, {}), ("zz", DAY0, {})])
    ordered = rows.select("event_id", E.arrival_order(F.col("event_id"), F.col("arrived_at")).alias("o")).orderBy("o")
    assert [r.event_id for r in ordered.collect()] == ["zz", "9-0", "9-9", "9-10", "10-0"]


def test_table_log_versions(spark, root):
    log = TableLog(spark, root, "conversations", schema.CONVERSATIONS.struct, "session_id")
    row = lambda i, s, t: (i, s, None, t, DAY0, DAY0)
    make = lambda rows: spark.createDataFrame(rows, log.struct)
    assert log.current().count() == 0
    log.append(make([row(1, "a", "1"), row(2, "b", "1")]), 0)
    log.append(make([row(1, "a", "2")]), 1)
    assert {r.session_id: r.title for r in log.current().collect()} == {"a": "2", "b": "1"}
    assert {r.session_id: r.title for r in log.current(before=1).collect()} == {"a": "1", "b": "1"}
    only = spark.createDataFrame([("1",)], "title string")
    assert {r.session_id: r.title for r in log.current(only=only, on="title").collect()} == {"a": "2", "b": "1"}
    log.append(make([row(2, "b", "3")]), 2)
    log.append(make([row(3, "c", "1")]), 3)
    log.compact(1)
    whole = {"a": "2", "b": "3", "c": "1"}
    assert {r.session_id: r.title for r in log.current().collect()} == whole and log.folds() == [1]
    # A folded batch may be replayed: it sees the rows before it, and nothing is lost after it.
    assert {r.session_id: r.title for r in log.current(before=1).collect()} == {"a": "1", "b": "1"}
    log.append(make([row(1, "a", "2")]), 1)
    assert {r.session_id: r.title for r in log.current().collect()} == whole
    with pytest.raises(ValueError):
        log.compact(3)


def test_second_checkpoint_loses_nothing(spark, root):
    for n in (1, 2):
        frame(spark, [turn(n, n, f"q{n}")]).coalesce(1).write.parquet(f"{root}/in{n}")
        ChatFeed(spark, f"{root}/out").start(f"{root}/in{n}", f"{root}/ck{n}").awaitTermination()
    assert sorted(r.text for r in ChatFeed(spark, f"{root}/out").messages.current().collect()) == ["Q1", "Q2", "q1", "q2"]


def test_redelivery_without_new_events(spark, root):
    feed = ChatFeed(spark, root, max_retries=2, retry_limit=1)
    feed.process(frame(spark, [turn(10, 0, "a", user_metadata="[1]"), turn(9, 0, "b", user_metadata="[2]")]), 0)
    for minutes in (2, 3):
        feed.redeliver(DAY0 + timedelta(minutes=minutes))
    # Oldest first, by number: 9-0 goes before 10-0.
    assert [r.original_event_id for r in feed.letters.versions().orderBy("batch_id").collect()] == ["9-0", "10-0"]
    assert not any(p.startswith("run-") for p in os.listdir(ensure_checkpoint_dir(spark).removeprefix("file:")))


def test_repeated_and_missing_ids_are_told(spark, root):
    feed = ChatFeed(spark, root)
    rows = [turn(1, 5, "late"), turn(1, 0, "first"), turn(1, 5, "late"), (None, DAY0, None), (None, DAY0, None), (None, *turn(7, 1, "x")[1:])]
    feed.process(frame(spark, rows), 0)
    told = [r.disposition for r in feed.dispositions.current().collect()]
    assert sorted(told) == ["processed", "processed", "repeated_id", "repeated_id", "skipped_type", "skipped_type"]
    assert {r.text for r in feed.messages.current().where("role = 'user'").collect()} == {"first", "x"}


def test_byte_field_names(spark, root):
    rows = [("1-0", DAY0, [(b"event_type", b"qa_turn"), (b"session_\xffid", b"s"), (b"question", b"old"), (b"question\xff", b"new")])]
    entries = spark.createDataFrame(rows, "event_id string, arrived_at timestamp, e array<struct<key binary, value binary>>")
    entries.select("event_id", "arrived_at", F.map_from_entries("e").alias("fields")).write.parquet(f"{root}/in")
    read = E.chat_turns(E.read_events(spark, f"{root}/in")).first()
    assert (read.session_id, read.question) == ("s", "new")


def test_dimension_of_a_probe(spark, root):
    class Three:
        def embed_query(self, text):
            return [0.0, 0.0, 0.0]

    feed = ChunkFeed(spark, root, embedder=Three)
    feed.process(frame(spark, [chunk(1, 0, "x")]), 0)
    assert feed.embeddings.current().first().dimension == 3


def test_first_within_watermark(spark, root):
    from ledgerflow.streaming.watermark import first_within

    def arrive(rows):
        data = [(k, DAY0 + timedelta(seconds=s), n) for k, s, n in rows]
        spark.createDataFrame(data, "idempotency_key string, arrived_at timestamp, n int").coalesce(1).write.mode("append").parquet(f"{root}/in")

    def run():
        stream = spark.readStream.schema("idempotency_key string, arrived_at timestamp, n int").parquet(f"{root}/in")
        query = first_within(stream, delay="10 seconds").writeStream.format("parquet").option("path", f"{root}/out")
        query.option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.n for r in spark.read.parquet(f"{root}/out").collect())

    arrive([("a", 0, 1), ("b", 5, 2)])
    assert run() == [1, 2]
    arrive([("a", 8, 3), ("c", 60, 4)])
    assert run() == [1, 2, 4]
    arrive([("a", 70, 5)])
    assert run() == [1, 2, 4, 5]


def test_capped_batches_equal_batches_of_that_size(spark, root):
    """Slices are batches of their own, in arrival order; a replay finds them again."""
    feed = ChatFeed(spark, root, max_events=2)
    events = frame(spark, [turn(24, 4, "e"), turn(20, 0, "a"), turn(23, 3, "a"), turn(21, 1, "b"), turn(22, 2, "c")])
    for _ in range(2):
        feed.process(events, 0)
        assert outcomes(feed) == {
            (0, "20-0"): "processed", (0, "21-0"): "processed", (1, "22-0"): "processed", (1, "23-0"): "duplicate", (2, "24-0"): "processed"}
    feed.process(frame(spark, []), 1)
    feed.process(frame(spark, [turn(25, 5, "f")]), 2)
    assert outcomes(feed)[(4, "25-0")] == "processed"
    assert feed.messages.current().count() == 10


def test_numbered_slices(spark):
    same = [turn(1, 0, "a")] * 3
    rows = frame(spark, [*same, (None, DAY0 + timedelta(seconds=1), None), (None, None, None), turn(2, 9, "b")])
    for every in (1, 100):
        found = E.numbered_slices(rows, 2, every).orderBy("slice").select("event_id", "slice").collect()
        assert [r.slice for r in found] == [0, 0, 1, 1, 2, 2]
        assert [r.slice for r in found if r.event_id == "2-0"] == [2]
    assert E.numbered_slices(rows.limit(0), 2).isEmpty()
    with pytest.raises(ValueError):
        E.numbered_slices(rows, 0)


def test_ids_and_names_in_bytes(spark, root):
    rows = [(b"\xff1-0", DAY0, {b"event_type\xff": b"qa_turn"}), (None, DAY0, None)]
    spark.createDataFrame(rows, "event_id binary, arrived_at timestamp, fields map<binary, binary>").write.parquet(f"{root}/raw")
    found = {r.event_id: r.fields for r in E.read_events(spark, f"{root}/raw").collect()}
    assert found == {"1-0": {"event_type": bytearray(b"qa_turn")}, None: {}}
