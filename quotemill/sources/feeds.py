"""Raw messages from landing folders and Kafka, batch and streaming."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed_values as fv
from ..schemas import RAW


def from_text_lines(lines: DataFrame, source_name: str | None = None) -> DataFrame:
    """Text lines, one payload per line, to raw messages.

    The arrival time is the time the file was written, so a replayed file gives the same rows. The sequence number
    only orders equal arrival times; a stream cannot number its rows and leaves it to :func:`with_sequence`. Without a
    ``source_name`` the folder column of that name is used.
    """
    number = F.lit(None).cast("bigint") if lines.isStreaming else F.monotonically_increasing_id()
    name = F.col("source_name") if source_name is None else F.lit(source_name)
    return lines.select(
        name.alias("source_name"),
        F.col("value").alias("payload"),
        F.lit(fv.TEXT_MESSAGE).alias("message_type"),
        F.col("_metadata.file_modification_time").alias("received_at"),
        number.alias("seq"),
    )


def with_sequence(messages: DataFrame) -> DataFrame:
    """Number the messages of a micro-batch that came without a sequence."""
    return messages.withColumn("seq", F.coalesce("seq", F.monotonically_increasing_id()))


def read_text(spark: SparkSession, path: str, source_name: str | None = None) -> DataFrame:
    return from_text_lines(spark.read.text(path), source_name)


def stream_text(spark: SparkSession, path: str, source_name: str, max_files: int = 1000) -> DataFrame:
    """One source's landing folder as a stream of its own."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return from_text_lines(lines, source_name)


def read_messages(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Messages a collector stored with their arrival time and sequence number."""
    return spark.read.schema(RAW).format(file_format).load(path)


def stream_messages(spark: SparkSession, path: str, file_format: str = "parquet",
                    max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(RAW).format(file_format).option("maxFilesPerTrigger", max_files).load(path)


def from_kafka(records: DataFrame, source_name: Column | None = None) -> DataFrame:
    """Kafka records to raw messages: topic, timestamp and (partition, offset) become source, arrival and sequence.

    Offsets repeat in the partitions of a topic, so the partition takes the bits above 48."""
    return records.select(
        (F.col("topic") if source_name is None else source_name).alias("source_name"),
        F.col("value").cast("string").alias("payload"),
        F.lit(fv.TEXT_MESSAGE).alias("message_type"),
        F.col("timestamp").alias("received_at"),
        (F.shiftleft(F.col("partition").cast("bigint"), 48) + F.col("offset")).alias("seq"),
    )


def stream_kafka(spark: SparkSession, servers: str, topics: str, max_offsets: int = 5_000_000) -> DataFrame:
    """A Kafka subscription; needs the Kafka package of Spark on the class path."""
    records = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topics)
        .option("maxOffsetsPerTrigger", max_offsets)
        .load()
    )
    return from_kafka(records)


def union_of(feeds: list[DataFrame]) -> DataFrame:
    """All sources as one feed."""
    return reduce(lambda left, right: left.unionByName(right), feeds)
