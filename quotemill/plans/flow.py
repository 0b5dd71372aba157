"""The whole batch job: raw messages to load outcomes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Options
from ..operators import dedup, load, normalize
from ..operators.formats import FORMATS
from ..session import materialize, prepare
from ..sources.registry import check_formats, registry


HEAD = 1024  # characters of an oversize message that are kept


@dataclass(frozen=True)
class Flow:
    """The frames of one run; each holds all its rows. Ticks are checked and routed when that is first asked for."""

    parsed: DataFrame
    ticks: DataFrame
    accepted: DataFrame
    batch_size: int
    scope: str

    @cached_property
    def routed(self) -> DataFrame:
        checked = load.check_constraints(load.assign_batches(self.accepted, self.batch_size))
        return load.route(checked, self.scope)


def slim(parsed: DataFrame) -> DataFrame:
    """Parsed rows with the payload kept only where it explains a rejection, and the beginning of oversize ones."""
    payload = F.col("payload")
    return parsed.withColumn(
        "payload", F.when(F.col("status") == "invalid", payload).when(F.col("status") == "oversize", F.left(payload, F.lit(HEAD)))
    )


def run(raw: DataFrame, options: Options = Options(), scope: str = "batch") -> Flow:
    """Parse and de-duplicate; check and route what was accepted.

    The parsed rows are written once, because several steps read different columns of them and reading JSON again
    would cost more than the table.
    """
    spark = prepare(raw.sparkSession)
    check_formats(options.check().sources, FORMATS)
    sources = registry(spark, options.sources)
    parsed = materialize(
        slim(normalize.parse(raw, sources, max_bytes=options.max_message_bytes)), "parsed"
    )
    ticks = normalize.ticks(parsed)
    accepted = dedup.accept(ticks, options.dedup_window_ms)
    return Flow(parsed, ticks, accepted, options.batch_size, scope)


def outcomes(flow: Flow, stored: DataFrame) -> DataFrame:
    """Accepted ticks with the outcome a load into ``stored`` gives them."""
    return load.load_outcome(flow.routed, stored)


def empty_table(spark: SparkSession) -> DataFrame:
    """A stored table without rows."""
    return spark.createDataFrame([], load.table_schema())
