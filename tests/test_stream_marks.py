"""Rules in stream state against the same rules over the whole table."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerflow.operators import dedup
from ledgerflow.streaming.marks import flag_repeats
from ledgerflow.streaming.retries import route_by_timers

DAY0 = datetime(2024, 1, 1)
SCHEMA = "k string, at timestamp, n long"


def test_marks_over_cuts_and_a_restart(spark, tmp_path):
    draw, at, rows = random.Random(4), 0, []
    for n in range(300):
        at += draw.choice([0, 1, 5, 30, 200])
        rows.append((draw.choice(["a", "b", "c", None]), DAY0 + timedelta(seconds=at), n))
    # Exactly the TTL later is a repeat, a microsecond more is not.
    end = DAY0 + timedelta(seconds=at + 1000)
    rows += [("x", end, 1000), ("x", end + timedelta(seconds=50), 1001), ("x", end + timedelta(seconds=50, microseconds=1), 1002), ("x", None, 1003)]
    source, sink, progress = (str(tmp_path / name) for name in ("in", "out", "progress"))
    cuts = [0, 7, 8, 120, 121, 301, len(rows)]
    for number, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        # Every run starts a new query on the same checkpoint.
        spark.createDataFrame(rows[lo:hi], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        flagged = flag_repeats(spark.readStream.schema(SCHEMA).parquet(source), "k", "at", "n", ttl_seconds=50, late="1 second")
        flagged.writeStream.option("checkpointLocation", progress).trigger(availableNow=True).start(sink).awaitTermination()
    got = {r.n: r.repeat for r in spark.read.parquet(sink).collect()}
    timed = spark.createDataFrame(rows, SCHEMA).where("at IS NOT NULL").select(F.coalesce("k", F.lit("none")).alias("k"), F.unix_micros("at").alias("now"), "n")
    marks = {r.n for r in dedup.first_seen(timed, "k", "now", "n", ttl_seconds=50).collect()}
    assert set(got) == {n for _, at, n in rows if at is not None}
    assert {n for n, repeat in got.items() if not repeat} == marks
    assert (got[1001], got[1002]) == (True, False)


def plain_routes(rows, end, max_retries, ttl, idle, cap):
    """Routes of ``(event_id, seconds, payload)`` in order; retries due before ``end`` come out."""
    state, out = {}, set()
    for event, now, payload in rows:
        attempts, last, due, held = state.get(event, (0, None, None, None))
        if due is not None and due <= now:
            out.add((event, attempts, "retry", due, held))
        attempts = attempts + 1 if last is not None and last + ttl >= now else 1
        if attempts >= max_retries:
            out.add((event, attempts, "dead_letter", now, payload))
            state[event] = (0, None, None, None)
        else:
            state[event] = (attempts, now, now + max(min(2 ** (attempts - 1), cap), idle), payload)
    return out | {(e, n, "retry", due, held) for e, (n, _, due, held) in state.items() if due is not None and due < end}


def test_retries_by_timers_over_cuts_and_restarts(spark, tmp_path):
    draw, at, rows = random.Random(7), 0, []
    for n in range(250):
        at += draw.choice([0, 1, 2, 4, 6, 40])
        rows.append((draw.choice(["a", "b", "c", "d", None]), at, draw.choice([f"p{n}", None])))
    rows += [("once", at + 3, "p"), ("last", at + 500, "q")]
    source, sink, progress = (str(tmp_path / name) for name in ("in", "out", "progress"))
    cuts = [0, 5, 6, 100, 180, len(rows)]
    schema = "stream string, event_id string, failed_at timestamp, payload string"
    for lo, hi in zip(cuts, cuts[1:]):
        part = [("s", e, DAY0 + timedelta(seconds=t), p) for e, t, p in rows[lo:hi]] + [("s", "none", None, "x")]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        routed = route_by_timers(spark.readStream.schema(schema).parquet(source), 4, 1.0, 8.0, 3.0, 30, "1 second")
        routed.writeStream.option("checkpointLocation", progress).trigger(availableNow=True).start(sink).awaitTermination()
    got = [(r.event_id, r.attempts, r.disposition, (r.at - DAY0).total_seconds(), r.payload) for r in spark.read.parquet(sink).collect()]
    # Two failures of one event at one time have no order; their payloads are told apart by the rest.
    want = plain_routes(rows, rows[-1][1] - 1, 4, 30, 3, 8)
    assert sorted(g[:4] for g in got if g[0]) == sorted(w[:4] for w in want if w[0])
    assert len(got) == len(want) and {r[2] for r in got} == {"retry", "dead_letter"}
    assert ("once", 1, "retry", at + 6, "p") in got
