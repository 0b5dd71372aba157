"""The continuous job: raw stream to stored table, with an exact de-duplication ledger."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Options
from ..operators import audit, dedup, load, normalize
from ..operators.deadletter import read_dead_letters, write_oversize, write_rejects
from ..operators.formats import FORMATS
from ..plans.flow import slim
from ..schemas import DEAD_LETTER, TICK
from ..session import materialize, prepare, scratch
from ..sources.feeds import with_sequence
from ..sources.registry import check_formats, registry
from .writer import BatchWriter

LEDGER = "id string, anchor_at timestamp, stream string, last_hour string, run string, batch_no bigint"
LEDGER_HOURS = 24  # how far arrivals of one stream may lie apart between micro-batches
# Spark keeps it in the checkpoint and sets it while a micro-batch runs
QUERY_ID = "sql.streaming.queryId"
COUNTS = (
    "batch_no bigint, raw bigint, invalid bigint, oversize bigint, accepted bigint, duplicate bigint, written bigint, "
    "conflicts bigint, dead_lettered bigint, dropped bigint, attempt_failures bigint, stream string"
)


def _hour(micros: int) -> str:
    return datetime.fromtimestamp(micros // 1_000_000, timezone.utc).strftime("%Y%m%d%H")


class Ingest:
    """Processes micro-batches into the folders below ``root``.

    ticks/ is the stored table, ledger/ holds the accepted arrivals that still suppress copies, rejected/, oversize/ and
    dead_letter/ the failures, outcomes/ one row of counts per batch. Everything a batch writes lies in folders named
    after the stream, run and batch, so a replayed batch replaces its own output and nothing else. The run is the id of
    the streaming query, which lives in its checkpoint: a new checkpoint numbers its batches from 0 again, but never
    touches what another one stored.

    The micro-batch is the unit that fails: blocks of the arrival sequence are cut inside it, so a block that a trigger
    splits in two is judged as two.

    The ledger is the state of the job. It is dropped behind the window, ``ledger_hours`` further back than the oldest
    arrival of a batch, as arrivals of a stream that are read again or out of order may come that late. None keeps it all.

    Sources never share an id. One query over the union of sources and one query per source (each with its own
    ``stream`` name) fill the same folders with the same ticks; the second keeps a failing source from stopping the
    others.
    """

    def __init__(self, root: str, stream: str = "all", options: Options = Options(), writer: BatchWriter | None = None,
                 ledger_hours: int | None = LEDGER_HOURS):
        self.root = root.rstrip("/")
        self.stream = stream
        self.options = options.check()
        self.ledger_hours = ledger_hours
        self.writer = writer or BatchWriter(f"{self.root}/ticks", f"{self.root}/dead_letter", options)

    def _ledger_hours(self, spark: SparkSession) -> dict[str, object]:
        """The folders of this stream, by the hour of the last arrival of the batches in them."""
        path_of = spark._jvm.org.apache.hadoop.fs.Path
        pattern = path_of(f"{self.root}/ledger/stream={self.stream}/last_hour=*")
        found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
        return {status.getPath().getName().split("=")[1]: status.getPath() for status in found}

    def ledger(self, spark: SparkSession, since: str = "") -> DataFrame:
        """Anchors of the batches of this stream that reach an hour; earlier folders are not listed."""
        hours = [hour for hour in sorted(self._ledger_hours(spark)) if hour >= since]
        if not hours:
            return spark.createDataFrame([], LEDGER)
        root = f"{self.root}/ledger"
        folders = [f"{root}/stream={self.stream}/last_hour={hour}" for hour in hours]
        return spark.read.schema(LEDGER).option("basePath", root).parquet(*folders)

    def outcomes(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(COUNTS).json(f"{self.root}/outcomes")

    def fingerprints(self, parsed: DataFrame) -> DataFrame:
        """What became of messages, read and parsed again, by the rows in the folders of this job: for :mod:`..operators.audit`.

        Needs the ledger of all their hours, so a job whose ledger is kept (``ledger_hours=None``) or messages this young."""
        spark = parsed.sparkSession

        def read(folder: str, empty: DataFrame) -> DataFrame:
            path = f"{self.root}/{folder}"
            return spark.read.schema(empty.schema).parquet(path) if load.path_exists(spark, path) else empty

        rejected = read("rejected", spark.createDataFrame([], normalize.rejects(parsed).schema))
        letters = f"{self.root}/dead_letter"
        found = load.path_exists(spark, letters)
        buried = read_dead_letters(spark, letters) if found else spark.createDataFrame([], DEAD_LETTER)
        return audit.outputs(
            parsed, rejected, self.ledger(spark).select("id", "anchor_at"), load.read_table(spark, f"{self.root}/ticks"), buried,
            self.options.dedup_window_ms,
        )

    def process(self, raw: DataFrame, batch_no: int, run: str | None = None) -> None:
        """One micro-batch. A plain batch job names its own ``run``; the same run and number mean the same input."""
        spark = prepare(raw.sparkSession)
        run = run or spark.sparkContext.getLocalProperty(QUERY_ID)
        if not run:
            raise ValueError("outside a streaming query, give the run a name")
        with scratch(spark):
            self._process(spark, raw, batch_no, run)

    def _process(self, spark: SparkSession, raw: DataFrame, batch_no: int, run: str) -> None:
        load_id = f"{self.stream}-{run}-{batch_no:012d}"
        parsed = materialize(
            slim(normalize.parse(with_sequence(raw), registry(spark, self.options.sources),
                                 max_bytes=self.options.max_message_bytes)),
            "parsed",
        )
        ticks = normalize.ticks(parsed)
        totals = parsed.agg(
            F.count(F.when(F.col("status") != "oversize", 1)).alias("raw"),
            F.count(F.when(F.col("status") == "invalid", 1)).alias("invalid"),
            F.count(F.when(F.col("status") == "oversize", 1)).alias("oversize"),
            F.count(F.when(F.col("status") == "valid", 1)).alias("valid"),
            F.min(F.when(F.col("status") == "valid", F.unix_micros("received_at"))).alias("first_at"),
            F.max(F.when(F.col("status") == "valid", F.unix_micros("received_at"))).alias("last_at"),
        ).first()
        counts = {"raw": totals["raw"], "invalid": totals["invalid"], "oversize": totals["oversize"],
                  "accepted": 0, "duplicate": 0}
        if totals["invalid"]:
            write_rejects(normalize.rejects(parsed), f"{self.root}/rejected", load_id)
        if totals["oversize"]:
            write_oversize(normalize.oversize(parsed), f"{self.root}/oversize", load_id)
        if totals["valid"]:
            accepted = self._deduplicate(ticks, totals["first_at"], totals["last_at"], batch_no, run)
            counts["accepted"] = accepted.count()
            counts["duplicate"] = totals["valid"] - counts["accepted"]
            counts.update(self.writer.write(accepted, load_id))
        names = [c.split()[0] for c in COUNTS.split(", ")]
        row = {"batch_no": batch_no, "stream": self.stream, **counts}
        (
            spark.createDataFrame([tuple(row.get(n, 0) for n in names)], COUNTS)
            .drop("stream")
            .coalesce(1)
            .write.mode("overwrite")
            .json(f"{self.root}/outcomes/stream={self.stream}/load_id={load_id}")
        )

    def _deduplicate(self, ticks: DataFrame, first_at: int, last_at: int, batch_no: int, run: str) -> DataFrame:
        spark = ticks.sparkSession
        horizon = first_at - self.options.dedup_window_ms * 1000
        since, last_hour = _hour(horizon), _hour(last_at)
        # Anchors of this or a later batch of the run are left out, so that a replay decides as the first time.
        earlier = (F.col("run") != run) | (F.col("batch_no") < batch_no)
        anchors = self.ledger(spark, since).filter(earlier & (F.col("anchor_at") > F.timestamp_micros(F.lit(horizon))))
        accepted = materialize(
            dedup.accept_after(ticks, anchors, self.options.dedup_window_ms).select(*TICK), "accepted"
        )
        folder = f"{self.root}/ledger/stream={self.stream}/last_hour={last_hour}/run={run}/batch_no={batch_no}"
        accepted.select("id", F.col("received_at").alias("anchor_at")).write.mode("overwrite").parquet(folder)
        if self.ledger_hours is not None:
            horizon_at = datetime.fromtimestamp(horizon / 1_000_000, timezone.utc)
            self.expire_ledger(spark, horizon_at - timedelta(hours=self.ledger_hours))
        return accepted

    def expire_ledger(self, spark: SparkSession, before: datetime) -> int:
        """Drop the ledger hours before a moment; needed for bounded state, never for correct results."""
        limit = _hour(int(before.timestamp() * 1_000_000))
        expired = [path for hour, path in self._ledger_hours(spark).items() if hour < limit]
        for path in expired:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        return len(expired)

    def start(self, raw: DataFrame, checkpoint: str, interval: str | None = None):
        """Start the query; without an ``interval`` it processes what is available and stops."""
        check_formats(self.options.sources, FORMATS)
        trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
        return (
            raw.writeStream.queryName(f"ingest-{self.stream}")
            .foreachBatch(self.process)
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .start()
        )


def fast_dedup(ticks: DataFrame, window_ms: int) -> DataFrame:
    """The built-in streaming alternative: less work per batch, not exact.

    It suppresses an id until the watermark has passed its window, so for longer than the rule, and drops rows that
    arrive behind the watermark. Use it where only the first copy matters.
    """
    delay = f"{window_ms} milliseconds"
    return ticks.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["id"])
