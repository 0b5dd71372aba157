"""Dead letters and rejected messages."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import DEAD_LETTER

TIME_PATTERN = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def dead_letters(ticks: DataFrame, error_type: Column, error_message: Column, failed_at: datetime) -> DataFrame:
    """Failed ticks as dead-letter records."""
    tick = F.struct(
        "id", "symbol", "price", "volume", F.col("event_time").alias("timestamp"), "source", "received_at"
    )
    return ticks.select(
        tick.alias("tick"),
        F.lit(failed_at).cast("timestamp").alias("failed_at"),
        error_type.alias("error_type"),
        error_message.alias("error_message"),
    )


def append_dead_letters(records: DataFrame, path: str, load_id: str, failed_at: datetime) -> None:
    """Write records as JSON lines, in a folder per UTC day of failure and load.

    A repeated load replaces its own folder. An empty frame writes nothing.
    """
    if records.isEmpty():
        return
    day = failed_at.astimezone(timezone.utc).strftime("%Y%m%d")
    records.write.mode("overwrite").option("timestampFormat", TIME_PATTERN).json(
        f"{path}/failed_date={day}/load_id={load_id}"
    )


def read_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    schema = DEAD_LETTER + ", failed_date string, load_id string"
    return spark.read.schema(schema).option("timestampFormat", TIME_PATTERN).json(path)


def write_rejects(rejected: DataFrame, path: str, load_id: str) -> None:
    """Keep invalid messages with their reason; a repeated load replaces its own folder."""
    rejected.write.mode("overwrite").parquet(f"{path}/load_id={load_id}")


def write_oversize(messages: DataFrame, path: str, load_id: str) -> None:
    """Keep what is known of messages above the size limit, and the beginning of each; a repeated load replaces its folder."""
    messages.write.mode("overwrite").parquet(f"{path}/load_id={load_id}")
