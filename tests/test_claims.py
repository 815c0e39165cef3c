"""Ordered claims and judged chunks against handling the rows one by one."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerflow.functions import keys as K
from ledgerflow.functions.embedding import embed_texts
from ledgerflow.operators import claims, groups
from ledgerflow.sources import events as E
from ledgerflow.streaming.feeds import ChunkFeed, prepared_chunks

DAY0 = datetime(2024, 1, 1)


def one_by_one(rows, stored):
    """Verdicts of (key, a, b, order) rows, and what is held at the end."""
    held, verdicts = {k: (a, b) for k, a, b in stored}, {}
    for key, a, b, order in sorted(rows, key=lambda r: r[3]):
        free = all(v is None or held[k][i] != v for k in held if k != key for i, v in enumerate((a, b)))
        verdicts[order] = free
        if free:
            held[key] = (a, b)
    return verdicts


@pytest.mark.parametrize("seed, keys, values, nulls", [(1, 4, 4, 0.1), (2, 12, 6, 0.3), (3, 40, 60, 0.0), (4, 25, 3, 0.5), (5, 3, 2, 0.0)])
def test_claims_of_changing_keys(spark, seed, keys, values, nulls):
    draw = random.Random(seed)
    value = lambda kind: None if draw.random() < nulls else f"{kind}{draw.randrange(values)}"
    rows = [(f"k{draw.randrange(keys)}", value("a"), value("b"), i) for i in range(150)]
    stored, taken = [], set()
    for k in range(0, keys, 2):
        a, b = value("a"), value("b")
        if not taken & {a, b} - {None}:
            stored.append((f"k{k}", a, b))
            taken |= {a, b} - {None}
    columns = "key string, a string, b string"
    got = claims.resolve_claims(
        spark.createDataFrame(rows, columns + ", ord long"), spark.createDataFrame(stored, columns), "key", ["a", "b"], "ord"
    ).collect()
    assert {r.ord: r.accepted for r in got} == one_by_one(rows, stored) and len(got) == len(rows)


def test_many_versions_of_two_keys_take_few_rounds(spark, monkeypatch):
    draw = random.Random(9)
    rows = [(draw.choice("xy"), draw.choice(["shared", f"own{i % 7}"]), None, i) for i in range(10_000)]
    written = []
    for module in (claims, groups):
        plain = module.durable
        monkeypatch.setattr(module, "durable", lambda df, name="cut", plain=plain: written.append(name) or plain(df, name))
    got = claims.resolve_claims(spark.createDataFrame(rows, "key string, a string, b string, ord long"), None, "key", ["a", "b"], "ord").collect()
    assert {r.ord: r.accepted for r in got} == one_by_one(rows, [])
    assert len(written) < 20


def test_connected_chain(spark):
    edges = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(0, 300)] + [("z1", "z2"), ("z2", "z1"), ("z3", "z1")]
    random.Random(2).shuffle(edges)
    got = {r.id: r.component for r in groups.connected(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert set(got) == {x for e in edges for x in e}
    assert {c for i, c in got.items() if i[0] == "n"} == {"n0000"} and {got[z] for z in ("z1", "z2", "z3")} == {"z1"}


def picky():
    # Classes are made in functions, so that workers get them by value.
    class Picky:
        def embed_query(self, text):
            if "bad" in text:
                raise ValueError(f"cannot embed {text}")
            return [float(len(text))]

    return Picky


def chunk(number, text, chunk_id, given, at, metadata=None):
    fields = {
        "event_type": "index_chunk", "chunk_text": text, "idempotency_key": given,
        "chunk_metadata": metadata or f'{{"source": "s", "chunk_id": "{chunk_id}"}}',
    }
    return (f"{number}-0", DAY0 + timedelta(seconds=at), {k: v.encode() for k, v in fields.items()})


EVENTS = "event_id string, arrived_at timestamp, fields map<string,binary>"
TTL = 100


def expected(spark, batches, feed):
    """Each batch's outcomes by the rule, one event after the other, and the marks and texts that are left."""
    held, marks, outcomes = {}, {}, []
    for events in batches:
        frame = spark.createDataFrame(events, EVENTS).withColumn("redelivered", F.lit(False))
        rows = prepared_chunks(feed._ahead(E.chunk_events(frame))).select(
            "event_id", "arrived_at", "ord", "document_key", K.content_hash(F.col("chunk_text")).alias("hash"), "idempotency_key", "usable", "chunk_text"
        ).collect()
        done = {}
        for r in sorted(rows, key=lambda r: r.ord):
            now = (r.arrived_at - DAY0).total_seconds()
            last = marks.get(r.idempotency_key)
            if last is not None and last + TTL >= max(now, last):
                done[r.event_id] = "duplicate"
            elif not r.usable or "bad" in r.chunk_text:
                done[r.event_id] = "retry"
            elif any(k != r.document_key and (h == r.hash or i == r.idempotency_key) for k, (h, i) in held.items()):
                done[r.event_id] = "retry"
            else:
                held[r.document_key] = (r.hash, r.idempotency_key)
                marks[r.idempotency_key] = max(now, last or now)
                done[r.event_id] = "processed"
        outcomes.append(done)
    return outcomes, held


@pytest.mark.parametrize("seed", [1])
def test_chunks_are_judged_as_one_by_one(spark, tmp_path, seed):
    draw = random.Random(seed)
    at, number, batches = 0, 0, []
    for _ in range(2):
        events = []
        for _ in range(60):
            at += draw.choice([0, 1, 7, 40])
            number += 1
            text = draw.choice([f"text {draw.randrange(8)}", f"bad {draw.randrange(3)}", f"one {number}"])
            given = draw.choice(["", "", f"i{draw.randrange(6)}"])
            events.append(chunk(number, text, draw.randrange(4), given, at, draw.choice([None, None, None, "[1]"])))
        batches.append(events)
    feed = ChunkFeed(
        spark, str(tmp_path / "feed"), ttl_seconds=TTL, embed=lambda rows: rows.withColumn("embedding", embed_texts(picky(), F.col("page_content"))),
    )
    # No redeliveries, which would put more events into the second batch.
    feed.idle_seconds = 1e6
    want, held = expected(spark, batches, feed)
    for i, events in enumerate(batches):
        feed.process(spark.createDataFrame(events, EVENTS), i)
        got = {r.event_id: r.disposition for r in feed.dispositions.versions().where(F.col("batch_id") == i).collect()}
        assert got == want[i]
    assert {r.document_key: (r.content_hash, r.idempotency_key) for r in feed.documents.current().collect()} == held
    assert feed.vectors.current().where("embedding IS NULL").count() == 0


def test_embedding_errors_are_data(spark):
    class Whole:
        """Answers a batch at once, too few vectors for batches with a short text."""

        def embed_query(self, text):
            if text == "no":
                raise RuntimeError()
            return [1.0]

        def embed_documents(self, texts):
            return [[2.0] for t in texts if len(t) > 3]

    class Broken:
        def __init__(self):
            raise OSError("no client")

    def of(factory, *texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
        found = rows.select("i", embed_texts(factory, F.col("t")).alias("e")).orderBy("i").collect()
        return [(r.e.vector, r.e.error) for r in found]

    assert of(Whole, "long", "longer") == [([2.0], None)] * 2
    assert of(Whole, "long", "abc", "no", None) == [([1.0], None), ([1.0], None), (None, "RuntimeError"), (None, "no text")]
    assert of(picky(), "bad one", "good") == [(None, "cannot embed bad one"), ([4.0], None)]
    assert of(Broken, "a", "b") == [(None, "no client")] * 2
