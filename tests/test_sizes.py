"""Queries on tables that differ from the given ones as larger ones do."""

import hashlib
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import differences
from ledgerflow.operators.groups import picked
from ledgerflow.operators.ranking import grouped_rank
from ledgerflow.plans import reports
from ledgerflow.sources import events as E
from ledgerflow.streaming.feeds import ChatFeed, ChunkFeed
from ledgerflow.streaming.marks import flag_repeats


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def against_sql(spark, folder, name, *tables):
    con = duckdb.connect()
    for table in tables:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return differences(spark, con, reports.QUERIES[name], reports.SQL[name], folder)


def test_failing_texts_that_arrive_over_more_days_than_a_counter_lives(spark, folder):
    docs = spark.range(12).select(
        (F.col("id") * 40_000).alias("doc_id"), F.concat(F.lit("text "), F.repeat(F.lit("x"), (F.col("id") % 9).cast("int"))).alias("text"),
        F.lit("en").alias("lang"), F.lit("src1").alias("source"), F.lit(1).cast("long").alias("n_chars"),
    )
    docs.write.parquet(f"{folder}/documents.parquet")
    assert against_sql(spark, folder, "failing_embeddings", "documents") == ""


def moved_bytes(spark, step):
    """Bytes that the stages of a step shuffled and wrote."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def total():
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteBytes() + stages.apply(i).outputBytes() for i in range(stages.size()))

    before = total()
    step()
    return total() - before


def test_a_chunk_feed_moves_its_texts_a_few_times(spark, folder):
    text = F.concat(*[F.sha2(F.concat_ws("/", F.col("id"), F.lit(i)), 256) for i in range(200)])
    events = spark.range(400).select(
        F.concat("id", F.lit("-0")).alias("event_id"), F.timestamp_seconds(F.col("id")).alias("arrived_at"),
        F.create_map(F.lit("event_type"), F.lit(b"index_chunk"), F.lit("chunk_text"), text.cast("binary")).alias("fields"),
    )
    chunks = ChunkFeed(spark, folder)
    moved = moved_bytes(spark, lambda: chunks.process(events, 0))
    assert chunks.documents.current().count() == 400
    assert moved < 5 * 400 * 200 * 64


def test_a_chat_feed_writes_the_metadata_of_repeats_as_they_came(spark, folder):
    digits = F.concat(*[F.sha2(F.concat_ws("/", F.col("id"), F.lit(i)), 256) for i in range(200)])
    texts = {"event_type": F.lit("qa_turn"), "session_id": F.lit("s"), "question": F.lit("q"), "user_metadata": F.concat(F.lit('{"k": "'), digits, F.lit('"}'))}
    events = spark.range(400).select(
        F.concat("id", F.lit("-0")).alias("event_id"), F.timestamp_seconds(F.col("id")).alias("arrived_at"),
        F.create_map(*[c for name, col in texts.items() for c in (F.lit(name), col.cast("binary"))]).alias("fields"),
    )
    chat = ChatFeed(spark, folder)
    moved = moved_bytes(spark, lambda: chat.process(events, 0))
    assert chat.messages.current().count() == 2
    # Hex digits take half their size: as they arrived and as they are staged, not merged and rendered again.
    assert moved < 1.25 * 400 * 200 * 64


def test_stream_state_has_an_entry_per_bucket_not_per_key(spark, folder):
    rows = spark.range(600).select(F.concat(F.lit("k"), F.col("id") % 300).alias("k"), F.timestamp_seconds(F.col("id") + 1_000_000_000).alias("at"), F.col("id").alias("n"))
    rows.coalesce(1).write.parquet(f"{folder}/in")
    flagged = flag_repeats(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), "k", "at", "n", buckets=8)
    query = flagged.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    held = max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"])
    assert spark.read.parquet(f"{folder}/out").where("repeat").count() == 300
    # A value, a timer and the timer's index for each bucket.
    assert held <= 3 * 8


def test_slices_are_numbered_by_a_flat_order(spark):
    stamps = [None, -5, -1, 0, 3, 1 << 40]
    rows = spark.createDataFrame([(t, i) for t in stamps for i in (None, "", "a", "9-2", "9-10", "10-0")], "at long, id string")
    order = E.arrival_order(F.col("id"), F.timestamp_micros("at"))
    both = rows.select(F.struct(order.alias("o"), F.lit(1)).alias("plain"), E._order_text(order, F.lit(1).cast("long")).alias("flat"))
    assert [r.flat for r in both.orderBy("plain").collect()] == [r.flat for r in both.orderBy("flat").collect()]


def test_failing_events_are_not_broadcast_when_they_are_many(spark, folder):
    texts = {"event_type": F.lit("qa_turn"), "session_id": F.lit("s"), "question": F.col("id").cast("string"), "user_metadata": F.lit("[1]")}
    events = spark.range(120_000).select(
        F.concat(F.col("id").cast("string"), F.lit("-0")).alias("event_id"), F.timestamp_seconds(F.lit(1_704_067_200)).alias("arrived_at"),
        F.create_map(*[c for name, col in texts.items() for c in (F.lit(name), col.cast("binary"))]).alias("fields"),
    )
    failing = ChatFeed(spark, folder, max_retries=2)
    plans = []
    for log in (failing.attempts, failing.letters, failing.dispositions):
        def append(rows, batch_id, write=log.append):
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
            write(rows, batch_id)

        log.append = append
    failing.process(events, 0)
    failing.redeliver(datetime(2024, 1, 1, 1))
    assert len(plans) == 5 and not any("BroadcastExchange" in plan for plan in plans)
    letters = failing.letters.current()
    assert letters.select("original_event_id", "attempts").distinct().count() == letters.where("attempts = '2'").count() == 120_000
    assert failing.attempts.current().where("attempts > 0").isEmpty()


@pytest.mark.parametrize("keep", ["id % 5 < 2", "id % 5 > 1"])
def test_long_lists_of_picked_rows_are_not_broadcast(spark, keep):
    rows = spark.range(300_000).select(F.concat("id", F.lit("-0")).alias("event_id"), "id")
    chosen = picked(rows, rows, keep)
    assert "BroadcastExchange" not in chosen._jdf.queryExecution().executedPlan().toString()
    assert chosen.agg(F.count(F.lit(1)), F.count_if(F.expr(keep))).first() == (rows.where(keep).count(),) * 2


def test_the_search_for_a_global_place_is_compiled_and_rows_carry_no_points(spark):
    names = F.when(F.col("id") > 3, F.sha2(F.col("id").cast("string"), 256))
    df = spark.range(20_000).select("id", names.alias("o"), F.array("id").alias("wide"))
    ranked = grouped_rank(df.where("o IS NOT NULL").unionByName(df.where("id = 3")), [], "o", "n", every=20)
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and plan.index("Window") < plan.index("scalar-subquery") and "Join" not in plan
    # The NULL comes first.
    want = {i: place for place, i in enumerate(sorted(range(3, 20_000), key=lambda i: hashlib.sha256(str(i).encode()).hexdigest() if i > 3 else ""), 1)}
    assert {r.id: r.n for r in ranked.collect()} == want


def test_raw_files_are_cut_by_events(spark, folder):
    events = spark.range(0, 900_000, numPartitions=1).select(
        F.col("id").cast("string").alias("event_id"), F.timestamp_seconds("id").alias("arrived_at"), F.create_map(F.lit("a"), F.lit(b"b")).alias("fields")
    )
    reports.raw_files(events, f"{folder}/raw")
    sizes = [r["count"] for r in spark.read.parquet(f"{folder}/raw").groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 900_000 and max(sizes) <= 100_000
