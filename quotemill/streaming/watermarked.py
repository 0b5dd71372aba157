"""Keyed state: windows and sessions that close behind a watermark, and stalls that a timer finds.

The state of a source lives in the state store, keyed by the source. What reaches it is small: every task first sums its
messages per (source, time cell), so a source that sends a third of all messages is a few rows per task.

Watermarks are per source: the newest arrival of the source in *earlier* micro-batches, less the delay. A source that lags
behind the others is therefore never late because of them. A message is late when the window it belongs to has closed;
it is not dropped but returned as ``late``, so that closed, open and late messages always add up to the messages read.

Results are rows of a ``kind``. ``open`` rows show what a source still holds after a micro-batch; the newest ``version``
of a source replaces its earlier ones (:func:`current`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import fixed_values as fv
from ..functions.moments import floor_div
from ..functions.text import strip
from ..session import ship_code
from ..sources.registry import with_source
from .metrics import DELAY_MS

CLOSED, OPEN, LATE = "closed", "open", "late"
CELLS = "source string, timeout long, cell long, first_at long, last_at long, messages long"
WINDOWS = "source string, kind string, version long, at long, messages long"
WINDOW_STATE = "version long, newest long, ends array<bigint>, counts array<bigint>"
SESSIONS = "source string, kind string, version long, first_at long, last_at long, messages long"
SESSION_STATE = "version long, newest long, firsts array<bigint>, lasts array<bigint>, counts array<bigint>"
CHANGES = "source string, connected boolean, last_at long, messages long, by_timer boolean"
STALL_STATE = "connected boolean, last_at long, messages long"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages of one task per (source, timeout, cell)."""
    held: list[pa.Table] = []

    def merged() -> pa.Table:
        keys = ["source", "timeout", "cell"]
        table = pa.concat_tables(held).group_by(keys).aggregate([("first_at", "min"), ("last_at", "max"), ("messages", "sum")])
        columns = [*keys, "first_at_min", "last_at_max", "messages_sum"]
        return table.select(columns).rename_columns([*keys, "first_at", "last_at", "messages"])

    for batch in batches:
        # sums are nullable, and only tables of one schema are put together
        schema = pa.schema([pa.field(f.name, f.type) for f in batch.schema])
        held.append(pa.Table.from_arrays(batch.columns, schema=schema))
        if len(held) == 16:
            held = [merged()]
    if held:
        yield from merged().combine_chunks().to_batches()


def cells(messages: DataFrame, sources: DataFrame, width_ms: int | None = None) -> DataFrame:
    """First and last arrival and number of messages per source and cell, summed within each task.

    Cells are ``width_ms`` long, or as long as the idle timeout of their source. No shuffle."""
    ship_code(messages.sparkSession)
    at = F.unix_micros("received_at")
    timeout = F.col("idle_timeout_ms") * 1000
    width = timeout if width_ms is None else F.lit(width_ms * 1000)
    return with_source(messages, sources).filter(F.col("idle_timeout_ms").isNotNull()).select(
        F.lower(strip(F.col("source_name"))).alias("source"), timeout.alias("timeout"), floor_div(at, width).alias("cell"),
        at.alias("first_at"), at.alias("last_at"), F.lit(1).cast("long").alias("messages"),
    ).mapInArrow(_summed, CELLS)


def _gathered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The cells of one source in a micro-batch, in order; what several tasks summed of a cell is one row."""
    every = pd.concat(list(frames), ignore_index=True)
    return every.groupby("cell", sort=True).agg({"first_at": "min", "last_at": "max", "messages": "sum"}).reset_index()


def _rows(source: str, version: int, columns: list[str], **kinds: list[tuple]) -> pd.DataFrame:
    rows = [(source, kind, version, *row) for kind, found in kinds.items() for row in found]
    return pd.DataFrame(rows, columns=["source", "kind", "version", *columns])


def tumbling_counts(messages: DataFrame, sources: DataFrame, interval_ms: int = fv.HEARTBEAT_MS,
                    delay_ms: int = DELAY_MS) -> DataFrame:
    """Messages per source and interval, named by its end: ``closed`` once, when the source's watermark reaches the end."""
    interval, delay = interval_ms * 1000, delay_ms * 1000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, newest, ends, counts = state.get if state.exists else (0, None, [], [])
        held, late = dict(zip(ends, counts, strict=True)), []
        passed = None if newest is None else newest - delay
        for row in _gathered(frames).itertuples():
            end = (int(row.cell) + 1) * interval
            if passed is not None and end <= passed:
                late.append((end, int(row.messages)))
                continue
            held[end] = held.get(end, 0) + int(row.messages)
            newest = max(int(row.last_at), int(row.last_at) if newest is None else newest)
        if newest is not None:
            passed = newest - delay
        closed = sorted((end, n) for end, n in held.items() if passed is not None and end <= passed)
        rest = sorted((end, n) for end, n in held.items() if passed is None or end > passed)
        state.update((version + 1, newest, [end for end, _ in rest], [n for _, n in rest]))
        yield _rows(key[0], version + 1, ["at", "messages"], **{CLOSED: closed, OPEN: rest, LATE: late})

    return cells(messages, sources, interval_ms).groupBy("source").applyInPandasWithState(
        step, WINDOWS, WINDOW_STATE, "append", GroupStateTimeout.NoTimeout
    )


def session_activity(messages: DataFrame, sources: DataFrame, delay_ms: int = DELAY_MS) -> DataFrame:
    """Activity of each source between stalls: ``closed`` when the watermark passes the idle timeout after its last message.

    Messages closer than the timeout are judged together: an early one is not late if a later one of its cell is not."""
    delay = delay_ms * 1000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        source, timeout = key
        version, newest, firsts, lasts, counts = state.get if state.exists else (0, None, [], [], [])
        spans, late = list(zip(firsts, lasts, counts, strict=True)), []
        passed = None if newest is None else newest - delay
        for row in _gathered(frames).itertuples():
            span = (int(row.first_at), int(row.last_at), int(row.messages))
            if passed is not None and span[1] + timeout <= passed:
                late.append(span)
                continue
            spans.append(span)
            newest = max(span[1], span[1] if newest is None else newest)
        if newest is not None:
            passed = newest - delay
        merged: list[tuple[int, int, int]] = []
        for first, last, n in sorted(spans):
            if merged and first - merged[-1][1] < timeout:
                begun, until, so_far = merged[-1]
                merged[-1] = (begun, max(until, last), so_far + n)
            else:
                merged.append((first, last, n))
        closed = [s for s in merged if passed is not None and s[1] + timeout <= passed]
        rest = merged[len(closed):]
        state.update((version + 1, newest, *[[s[i] for s in rest] for i in range(3)]))
        yield _rows(source, version + 1, ["first_at", "last_at", "messages"], **{CLOSED: closed, OPEN: rest, LATE: late})

    return cells(messages, sources).groupBy("source", "timeout").applyInPandasWithState(
        step, SESSIONS, SESSION_STATE, "append", GroupStateTimeout.NoTimeout
    )


def connection_changes(messages: DataFrame, sources: DataFrame) -> DataFrame:
    """``connected`` becomes true with the first message of a source, and false when none came for its idle timeout.

    The second needs no message: a timer of the state fires at the first trigger after the timeout, by the clock of the
    job and not by arrival times. Any message sets the timer back, valid or not. ``messages`` counts those so far."""
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        source, timeout = key
        connected, last_at, messages = state.get if state.exists else (False, 0, 0)
        if state.hasTimedOut:
            state.update((False, last_at, messages))
            yield pd.DataFrame([(source, False, last_at, messages, True)], columns=columns)
            return
        found = _gathered(frames)
        last_at = max(last_at, int(found["last_at"].max()))
        messages += int(found["messages"].sum())
        state.update((True, last_at, messages))
        state.setTimeoutDuration(int(timeout) // 1000)
        if not connected:
            yield pd.DataFrame([(source, True, last_at, messages, False)], columns=columns)

    columns = [c.split()[0] for c in CHANGES.split(", ")]
    return cells(messages, sources).groupBy("source", "timeout").applyInPandasWithState(
        step, CHANGES, STALL_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def current(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Closed and late messages of all micro-batches, and of the open ones only the newest version of each source.

    Rows of one place and kind are added up: a place can be late several times."""
    newest = rows.groupBy("source").agg(F.max("version").alias("version")).withColumn("kind", F.lit(OPEN))
    kept = rows.filter(F.col("kind") != OPEN).unionByName(rows.join(newest, ["source", "kind", "version"], "left_semi"))
    return kept.groupBy("source", "kind", *keys).agg(F.sum("messages").alias("messages"))


def last_states(changes: DataFrame) -> DataFrame:
    """The newest change of each source. Of two with one message count, the timer's came second."""
    newest = changes.groupBy("source").agg(
        F.max_by(F.struct("connected", "last_at", "messages", "by_timer"), F.struct("messages", "by_timer")).alias("c")
    )
    return newest.select("source", "c.*")
