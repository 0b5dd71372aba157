"""Seconds of each of many micro-batches of the continuous job into one table: python tests/micro_batches.py [sf_dir] [batches]"""

from __future__ import annotations

import json
import sys
import time
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def main(sf_dir: str = "/root/testdata/sf0.01", batches: str = "30") -> None:
    from quotemill.session import local_session, materialize, work_folder
    from quotemill.sources import tables
    from quotemill.streaming.ingest import Ingest

    spark = local_session("micro-batches", "8", "8g")
    count = int(batches)
    raw = tables.raw_from_events(tables.read_events(spark, sf_dir), extended=True)
    # equal shares of the arrival sequence, in its order
    last = raw.agg(F.max("seq")).first()[0] + 1
    raw = materialize(raw.withColumn("part", F.expr(f"cast(seq * {count} div {last} as int)")), "feed")
    root = work_folder(spark, "micro")
    job, seconds = Ingest(root), []
    for n in range(count):
        started = time.perf_counter()
        job.process(raw.filter(F.col("part") == n).drop("part"), n, "run")
        seconds.append(round(time.perf_counter() - started, 2))
    total = job.outcomes(spark).agg(F.sum("raw").alias("raw"), F.sum("written").alias("written")).first()
    print(json.dumps({"seconds": seconds, **total.asDict()}))
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:])
