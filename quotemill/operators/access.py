"""Reads of stored or accepted ticks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import load


def instrument_history(ticks: DataFrame, source: str, symbol: str, start: datetime | None = None,
                       end: datetime | None = None) -> DataFrame:
    """Ticks of one source and symbol, newest first. On the stored table the filters prune folders and row groups."""
    found = ticks.filter((F.col("source") == source.lower()) & (F.col("symbol") == symbol.upper()))
    dated = "event_date" in ticks.columns
    if start is not None:
        found = found.filter(F.col("event_time") >= F.lit(start))
        if dated:
            found = found.filter(F.col("event_date") >= F.lit(start.date()))
    if end is not None:
        found = found.filter(F.col("event_time") < F.lit(end))
        if dated:
            found = found.filter(F.col("event_date") <= F.lit(end.date()))
    return found.orderBy(F.desc("event_time"), "id")


def latest_stored(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The newest n ticks of the stored table. One job counts the ticks of every day, without reading a column; only the
    newest days that hold n ticks are read."""
    table = load.read_table(spark, path)
    since, held = None, 0
    for since, ticks in sorted(table.groupBy("event_date").count().collect(), reverse=True):  # a row per day
        held += ticks
        if held >= n:
            break
    return latest(table if since is None else table.filter(F.col("event_date") >= F.lit(since)), n)


def latest(ticks: DataFrame, n: int) -> DataFrame:
    """The newest n ticks; every task keeps n rows."""
    return ticks.orderBy(F.desc("event_time"), "id").limit(n)


def latest_per_instrument(ticks: DataFrame) -> DataFrame:
    """The newest tick of every (source, symbol).

    The newest time comes from a hash aggregate over three columns, so the ticks are never sorted; only the ticks at
    that time are compared by id. ``ticks`` is read twice: pass a stored frame.
    """
    newest = ticks.groupBy("source", "symbol").agg(F.max("event_time").alias("event_time"))
    rest = [c for c in ticks.columns if c not in ("source", "symbol")]
    return (
        ticks.join(newest, ["source", "symbol", "event_time"], "left_semi")
        .groupBy("source", "symbol")
        .agg(F.max_by(F.struct(*rest), "id").alias("newest"))
        .select("source", "symbol", "newest.*")
    )


def replay_slice(messages: DataFrame, k: int) -> DataFrame:
    """The k most recent messages of each source with their position, oldest first.

    The rank filter is applied per task before the shuffle, so at most k rows per task and source travel.
    """
    newest_first = Window.partitionBy("source_name").orderBy(F.desc("received_at"), F.desc("seq"))
    oldest_first = Window.partitionBy("source_name").orderBy("received_at", "seq")
    kept = messages.withColumn("_back", F.row_number().over(newest_first)).filter(F.col("_back") <= k).drop("_back")
    return kept.withColumn("position", F.row_number().over(oldest_first))
