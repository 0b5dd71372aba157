"""The table of configured sources and its lookup."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Source
from ..schemas import SOURCES


def registry(spark: SparkSession, sources: Iterable[Source]) -> DataFrame:
    """One row per configured source. The rows come from configuration, so the table is always small."""
    rows = [(s.name, s.format, s.idle_timeout_ms) for s in sources]
    return spark.createDataFrame(rows, SOURCES)


def check_formats(sources: Iterable[Source], formats: Iterable[str]) -> None:
    """Raise before a job starts if a configured format has no reader."""
    known = {f.lower() for f in formats}
    for source in sources:
        if source.format.lower() not in known:
            raise ValueError(f"no reader for format '{source.format}' of source '{source.name}'")


def check_registry(sources: DataFrame, formats: Iterable[str]) -> DataFrame:
    """The same checks, and unique names ignoring case, for a registry that is itself a table."""
    known = [f.lower() for f in formats]
    problems = (
        sources.groupBy(F.lower("name").alias("name"))
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.lower("format")).alias("format"))
        .filter((F.col("n") > 1) | ~F.col("format").isin(known))
    )
    first = problems.first()
    if first is not None:
        if first["n"] > 1:
            raise ValueError(f"duplicate source name '{first['name']}'")
        raise ValueError(f"no reader for format '{first['format']}' of source '{first['name']}'")
    return sources


def with_source(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """Attach format and idle timeout to every message; names match ignoring case.

    Messages of sources that are not configured stay, with NULL settings.
    """
    lookup = F.broadcast(
        sources.select(
            F.lower("name").alias("_name"), F.lower("format").alias("format"), F.col("idle_timeout_ms")
        )
    )
    return raw.join(lookup, F.lower(F.trim("source_name")) == F.col("_name"), "left").drop("_name")
