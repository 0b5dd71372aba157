"""Headline queries, timed. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "tick_counts_by_source",
    "tick_identity",
    "tick_rejects_by_reason",
    "dedup_window",
    "idempotent_load",
    "outcomes_by_source",
    "heartbeat_10s",
    "source_sessions",
    "flap_streaks",
    "latest_per_instrument",
    "replay_slice",
    "stream_ticks",
    "bulk_identity",
    "bulk_outcomes",
    "bulk_latest_per_instrument",
    "bulk_heartbeat",
]


def main() -> None:
    from quotemill.plans.queries import QUERIES
    from quotemill.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_MEMORY", "16g"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    seconds, rates = {}, {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        rates[name] = round((lines if name.startswith("bulk_") else events) / seconds[name])
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "messages_per_sec": rates,
                "sf": Path(sf_dir).name,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
