"""Outcome counts: every received message ends in exactly one outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

OUTCOMES = ["raw", "invalid", "duplicate", "accepted", "written", "conflict", "dead_lettered", "dropped", "oversize"]


def by_source(parsed: DataFrame, loaded: DataFrame, duplicates: DataFrame | None = None) -> DataFrame:
    """Counts per source: one map-side aggregate over the parsed rows, one over the accepted ticks.

    ``loaded`` holds the accepted ticks with their ``outcome``. A valid message that was not accepted is a duplicate,
    so duplicates are a difference and need no join of the ticks. A balance that can fail needs them counted on their
    own: ``duplicates`` as from :func:`quotemill.operators.dedup.suppressed`.
    """
    def count_of(name: str, column: str):
        return F.count(F.when(F.col(column) == name, 1))

    received = parsed.groupBy(F.coalesce("source", F.lower("source_name")).alias("source")).agg(
        F.count(F.when(F.col("status") != "oversize", 1)).alias("raw"),
        count_of("invalid", "status").alias("invalid"),
        count_of("valid", "status").alias("valid"),
        count_of("oversize", "status").alias("oversize"),
    )
    ended = loaded.groupBy("source").agg(
        F.count(F.lit(1)).alias("accepted"),
        *[count_of(name, "outcome").alias(name) for name in ("written", "conflict", "dead_lettered", "dropped")],
    )
    filled = received.join(ended, "source", "left").na.fill(0)
    if duplicates is None:
        filled = filled.withColumn("duplicate", F.col("valid") - F.col("accepted"))
    else:
        counted = duplicates.groupBy("source").agg(F.count(F.lit(1)).alias("duplicate"))
        filled = filled.join(counted, "source", "left").na.fill(0, ["duplicate"])
    return filled.select("source", *OUTCOMES)


def long_form(counts: DataFrame) -> DataFrame:
    """(source, outcome, n) rows with n above zero."""
    return counts.unpivot("source", OUTCOMES, "outcome", "n").filter("n > 0")


def snapshot(counts: DataFrame, reconnects: DataFrame, failed_batches: DataFrame) -> DataFrame:
    """The global counters in one row. ``failed_batches``: a row for each write attempt that failed."""
    totals = counts.agg(
        F.sum("raw").alias("raw_ticks_received"),
        F.sum("accepted").alias("ticks_accepted"),
        F.sum("duplicate").alias("duplicate_ticks"),
        F.sum("invalid").alias("invalid_ticks"),
        F.sum("written").alias("ticks_written"),
        F.sum("conflict").alias("database_conflicts"),
        F.sum("dead_lettered").alias("ticks_dead_lettered"),
        F.sum("dropped").alias("ticks_dropped"),
    )
    scheduled = reconnects.agg(F.coalesce(F.sum("reconnects"), F.lit(0)).alias("reconnects_scheduled"))
    attempts = failed_batches.agg(F.count(F.lit(1)).alias("database_write_attempt_failures"))
    return totals.crossJoin(attempts).crossJoin(scheduled)  # one row by one row


def reconcile(counts: DataFrame) -> DataFrame:
    """Both balance equations per source; a difference means a tick without an outcome.

    In a batch job nothing waits in a queue, so nothing is dropped before it or in flight.
    """
    received_gap = F.col("raw") - F.col("accepted") - F.col("duplicate") - F.col("invalid")
    accepted_gap = (
        F.col("accepted") - F.col("written") - F.col("conflict") - F.col("dead_lettered") - F.col("dropped")
    )
    return counts.select(
        "source",
        "raw",
        "accepted",
        received_gap.alias("received_gap"),
        accepted_gap.alias("accepted_gap"),
        ((received_gap == 0) & (accepted_gap == 0)).alias("balanced"),
    )
