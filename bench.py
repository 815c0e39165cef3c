"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerflow.plans.reports import QUERIES  # noqa: E402
from ledgerflow.session import local_session  # noqa: E402

# Query name to the table whose rows its throughput counts.
HEADLINE = {
    "document_keys": "documents",
    "document_upsert": "documents",
    "document_claims": "documents",
    "chunk_receipts": "documents",
    "chunk_event_fields": "documents",
    "conversation_upsert": "conversations",
    "message_upsert": "conversations",
    "recorded_turns": "conversations",
    "history_pages": "conversations",
    "ttl_marks": "events",
    "chat_event_fields": "events",
    "chat_dispositions": "events",
    "chat_feed_messages": "events",
    "chunk_feed_documents": "documents",
    "failure_routes": "events",
    "surrogate_ids": "documents",
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    sizes = {t: spark.read.parquet(f"{folder}/{t}.parquet").count() for t in set(HEADLINE.values())}
    seconds, rates = {}, {}
    for name, source in HEADLINE.items():
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()  # warm up
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        rates[name] = round(sizes[source] / seconds[name])
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "rows_per_sec": rates, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
