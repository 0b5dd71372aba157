"""Feed metrics as streams, by arrival time, never by event time.

Each micro-batch leaves a small summary that can be merged with those of all others in any order. Results are made from
the merged summaries, so rows count however late they arrive, and no state has to be closed first. Streams that do close
their windows, and count what comes too late for them, are in :mod:`quotemill.streaming.watermarked`."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed_values as fv
from ..functions.moments import floor_div
from ..operators import activity
from .ingest import QUERY_ID

DELAY_MS = 600_000


def heartbeat_part(parsed: DataFrame, interval_ms: int = fv.HEARTBEAT_MS) -> DataFrame:
    """Raw, invalid and valid counts of some messages per interval."""
    interval = F.lit(interval_ms * 1000)
    ends = (floor_div(F.unix_micros("received_at"), interval) + 1) * interval
    return parsed.filter("status <> 'oversize'").groupBy(ends.alias("at")).agg(
        F.count(F.lit(1)).alias("raw"),
        F.count(F.when(F.col("status") == "invalid", 1)).alias("invalid"),
        F.count(F.when(F.col("status") == "valid", 1)).alias("valid"),
    )


def heartbeat_counts(parts: DataFrame) -> DataFrame:
    """Raw, invalid and valid counts per interval, of all micro-batches."""
    return parts.groupBy("at").agg(*[F.sum(n).alias(n) for n in ("raw", "invalid", "valid")])


def session_activity(parts: DataFrame, delay_ms: int = DELAY_MS) -> DataFrame:
    """All sessions between stalls, from the ``arrivals`` of every micro-batch, those still open included.

    ``ended`` tells that the newest message of all sources is ``delay_ms`` past the end of the session, so that no
    message less late than that can lengthen it. A later one still does, and may join two sessions."""
    found = activity.sessions_of(activity.merge_arrivals(parts))
    newest = found.agg(F.max("last_at").alias("newest"))
    # in whole milliseconds, as a watermark
    passed = floor_div(F.col("newest") - delay_ms * 1000, F.lit(1000)) * 1000
    return found.crossJoin(F.broadcast(newest)).select(
        "source", "first_at", "last_at", "messages", (F.col("last_at") + F.col("timeout") - 1 <= passed).alias("ended")
    )


def start_parts(stream: DataFrame, summary: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
                interval: str | None = None, drop_empty: bool = False):
    """Keep a summary of every micro-batch in a folder of its own, which is replaced when the batch runs again.

    A folder is named after the run and the batch. The run is the id of the streaming query, which lives in its
    checkpoint, so a new checkpoint, whose batches count from 0 again, adds to what is there. Without an ``interval``
    the query processes what is available and stops. ``drop_empty`` is for streams whose timers make batches without
    messages: a batch without rows leaves no folder. Its rows are written beside ``path`` and renamed into their place,
    so one who reads ``path`` while the stream runs finds whole folders, none of which disappears."""
    def keep(rows: DataFrame, batch_no: int) -> None:
        spark = rows.sparkSession
        run = spark.sparkContext.getLocalProperty(QUERY_ID)
        folder = f"run={run}/part={batch_no}"
        if not drop_empty:
            summary(rows).write.mode("overwrite").parquet(f"{path}/{folder}")
            return
        staged = spark._jvm.org.apache.hadoop.fs.Path(f"{path}-staged/{folder}")
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
        files = target.getFileSystem(spark._jsc.hadoopConfiguration())
        written = summary(rows)
        written.write.mode("overwrite").parquet(staged.toString())
        files.delete(target, True)  # of a batch that runs again
        if spark.read.schema(written.schema).parquet(staged.toString()).isEmpty():
            files.delete(staged, True)
        else:
            files.mkdirs(target.getParent())
            if not files.rename(staged, target):
                raise OSError(f"cannot rename {staged} to {target}")

    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    return (
        stream.writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def stop_between_batches(query, seconds: float = 60) -> None:
    """Stop a query while no micro-batch runs; one that is cut off would only be run again, but with errors in the log."""
    until = time.monotonic() + seconds
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() < until:
        time.sleep(0.02)
    query.stop()


def has_parts(spark: SparkSession, path: str) -> bool:
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/run=*/part=*/_SUCCESS")
    return bool(pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern))


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """The summaries of all micro-batches so far."""
    return spark.read.option("basePath", path).parquet(f"{path}/run=*").drop("run", "part")


def run_in_parts(stream: DataFrame, summary: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> DataFrame:
    """Run over what is available and return the summaries of all micro-batches so far, of earlier runs too."""
    start_parts(stream, summary, path, checkpoint).awaitTermination()
    return read_parts(stream.sparkSession, path)
