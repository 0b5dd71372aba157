"""Counters of a running stream, observed while it reads, without a job of their own."""

from __future__ import annotations

import threading
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..config import Source
from .metrics import start_parts

NAME = "messages"
RECEIVED = ("raw", "invalid", "oversize", "valid")


def observe(parsed: DataFrame, sources: Iterable[Source], name: str = NAME) -> DataFrame:
    """The same rows; what passes is counted per configured source and kind. The registry is small, so are the counts."""
    kind = {
        "raw": F.col("status") != "oversize",
        **{status: F.col("status") == status for status in ("invalid", "oversize", "valid")},
    }
    source = F.lower(F.trim("source_name"))
    counts = [
        F.count(F.when((source == s.name.lower()) & kind[k], 1)).alias(f"{s.name.lower()}:{k}") for s in sources for k in RECEIVED
    ]
    return parsed.observe(name, *counts)


class Counters(StreamingQueryListener):
    """Totals of what the streams of this session observed under a name, as a driver holds them: they start anew with it.

    Counts are kept per query and batch, so a batch that runs again replaces its own."""

    def __init__(self, name: str = NAME):
        self.name = name
        self._batches: dict[tuple[str, int], dict[str, int]] = {}
        self._ended: dict[str, threading.Event] = defaultdict(threading.Event)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is not None:
            self._batches[str(event.progress.id), event.progress.batchId] = found.asDict()

    def onQueryTerminated(self, event) -> None:
        self._ended[str(event.runId)].set()

    def wait_for(self, query, seconds: float = 60) -> None:
        """Until every event of a query has come; they come in order, the end last."""
        query.awaitTermination()
        if not self._ended[str(query.runId)].wait(seconds):
            raise TimeoutError(f"no end of query {query.runId} was reported")

    def batches(self) -> int:
        return len(self._batches)

    def totals(self, spark: SparkSession) -> DataFrame:
        """(source, raw, invalid, oversize, valid) of the sources that sent anything."""
        sums: dict[str, dict[str, int]] = defaultdict(lambda: dict.fromkeys(RECEIVED, 0))
        for counts in self._batches.values():
            for label, n in counts.items():
                source, _, kind = label.rpartition(":")
                sums[source][kind] += n
        rows = [(source, *[n[k] for k in RECEIVED]) for source, n in sums.items() if any(n.values())]
        return spark.createDataFrame(rows, "source string, " + ", ".join(f"{k} bigint" for k in RECEIVED))


def counted(parsed: DataFrame, sources: Iterable[Source], summary, path: str, checkpoint: str, listener: Counters,
            interval: str | None = None):
    """Start a metric stream whose messages are counted on the way, by the one job that each micro-batch is."""
    parsed.sparkSession.streams.addListener(listener)
    return start_parts(observe(parsed, sources, listener.name), summary, path, checkpoint, interval)
