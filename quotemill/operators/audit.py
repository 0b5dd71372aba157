"""An audit of what is stored: every message that was read must be found again, once, in the table that its outcome names.

The rules of the job are not used to count; the rows are. Each output is reduced to fingerprints per (source, hour of
arrival): a count, a sum and an exclusive-or of row hashes. They do not depend on any order and add up, so
the fingerprint of what was received must equal the sum of those of its outcomes. A row that was lost, stored twice or
changed shows in the hour it belongs to; the exclusive-or also tells a lost and a doubled row of one hour apart from none.

Fingerprints are map-side aggregates: one row per task, source and hour travels. The stored outputs are joined on ids only
to tell which accepted ticks had their id stored already.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions.moments import floor_div
from ..session import materialize

HOUR = 3_600_000_000
SIDES = ("received", "rejected", "duplicate", "accepted", "stored", "buried", "conflict")


def tick_hash() -> Column:
    """Of a tick in any output: its id and arrival, which all of them keep."""
    return F.xxhash64("id", F.unix_micros("received_at"))


def message_hash() -> Column:
    """Of a rejected message: it has no id, so its place in the arrival sequence."""
    return F.xxhash64(F.lower(F.trim("source_name")), "seq", F.unix_micros("received_at"))


def fingerprint(rows: DataFrame, side: str, source: Column, digest: Column, times: Column | None = None) -> DataFrame:
    """(source, hour, side, rows, total, parity) of some rows, each counted ``times``."""
    times = F.lit(1).cast("long") if times is None else times
    flat = rows.select(
        F.coalesce(F.lower(F.trim(source)), F.lit("")).alias("source"),
        floor_div(F.unix_micros("received_at"), HOUR).alias("hour"), digest.alias("h"), times.alias("times"),
    )
    return flat.groupBy("source", "hour").agg(
        F.sum("times").alias("rows"),
        F.sum(F.col("h").cast("decimal(38,0)") * F.col("times")).cast("decimal(38,0)").alias("total"),
        F.bit_xor(F.when(F.col("times") % 2 == 1, F.col("h")).otherwise(0)).alias("parity"),
    ).withColumn("side", F.lit(side))


def explained_copies(ticks: DataFrame, anchors: DataFrame, window_ms: int) -> DataFrame:
    """(id, source, received_at, times): ticks that are not accepted, and for which an accepted copy opened a window that
    holds them. ``anchors``: (id, anchor_at) of the accepted ticks as stored.

    Joined on id and window-long cells, in which an id has two anchors at most. Copies of one instant count as one row."""
    window = window_ms * 1000
    counted = ticks.groupBy("id", "source", "received_at").agg(F.count(F.lit(1)).alias("n"))
    arrived = F.unix_micros("received_at")
    opened = anchors.select("id", F.unix_micros("anchor_at").alias("opened_at")).withColumn(
        "cell", F.explode(F.array(floor_div(F.col("opened_at"), window), floor_div(F.col("opened_at"), window) + 1))
    )
    near = counted.withColumn("cell", floor_div(arrived, window)).join(opened, ["id", "cell"])
    since = arrived - F.col("opened_at")
    own = F.max(F.when(since == 0, 1).otherwise(0)).alias("own")
    held = near.filter((since >= 0) & (since < window)).groupBy("id", "source", "received_at").agg(F.max("n").alias("n"), own)
    return held.withColumn("times", F.col("n") - F.col("own")).filter("times > 0").drop("n", "own")


def outputs(parsed: DataFrame, rejected: DataFrame, anchors: DataFrame, stored: DataFrame, letters: DataFrame,
            window_ms: int = fv.DEDUP_WINDOW_MS) -> DataFrame:
    """Fingerprints of all sides of the balance.

    ``parsed``: the messages as read again; ``rejected``, ``anchors`` (id, anchor_at), ``stored``, ``letters``: the tables
    that the job has written."""
    ticks = materialize(parsed.filter("status = 'valid'").select("id", "source", "received_at"), "audit-ticks")
    # anchors carry no source; the ticks that they were once do
    accepted = materialize(
        ticks.distinct().join(anchors.select("id", F.col("anchor_at").alias("received_at")), ["id", "received_at"]),
        "audit-accepted",
    )
    buried = letters.select(
        F.col("tick.id").alias("id"), F.col("tick.source").alias("source"), F.col("tick.received_at").alias("received_at")
    )
    held = materialize(stored.select("id", "source", "received_at"), "audit-stored")
    ended = held.unionByName(buried).select("id", "received_at").distinct()
    # accepted, neither stored nor buried as such, but the id is stored: a conflict
    conflicts = accepted.join(ended, ["id", "received_at"], "left_anti").join(held.select("id").distinct(), "id", "left_semi")
    copies = explained_copies(ticks, anchors, window_ms)
    source, tick = F.col("source"), tick_hash()
    message = F.col("source_name")
    invalid = parsed.filter("status = 'invalid'")
    sides: Iterable[DataFrame] = (
        fingerprint(ticks, "received", source, tick), fingerprint(invalid, "received", message, message_hash()),
        fingerprint(rejected, "rejected", message, message_hash()),
        fingerprint(copies, "duplicate", source, tick, F.col("times")),
        fingerprint(accepted, "accepted", source, tick), fingerprint(held, "stored", source, tick),
        fingerprint(buried, "buried", source, tick), fingerprint(conflicts, "conflict", source, tick),
    )
    return reduce(DataFrame.unionByName, sides).groupBy("source", "hour", "side").agg(
        F.sum("rows").alias("rows"), F.sum("total").alias("total"), F.bit_xor("parity").alias("parity")
    )


def balance(fingerprints: DataFrame) -> DataFrame:
    """Both equations per (source, hour): received = rejected + duplicate + accepted, accepted = stored + buried + conflict.

    ``*_gap`` is the difference in rows, ``*_same`` that sums and exclusive-ors agree as well."""
    columns = []
    for side in SIDES:
        here = F.col("side") == side
        columns += [
            F.coalesce(F.sum(F.when(here, F.col("rows"))), F.lit(0)).alias(side),
            F.coalesce(F.sum(F.when(here, F.col("total"))), F.lit(0)).alias(f"{side}_total"),
            F.coalesce(F.bit_xor(F.when(here, F.col("parity"))), F.lit(0)).alias(f"{side}_parity"),
        ]
    wide = fingerprints.groupBy("source", "hour").agg(*columns)

    def gap(whole: str, parts: tuple[str, ...], end: str = "") -> Column:
        return reduce(lambda left, p: left - F.col(p + end), parts, F.col(whole + end))

    def parity(whole: str, parts: tuple[str, ...]) -> Column:
        return reduce(lambda left, p: left.bitwiseXOR(F.col(f"{p}_parity")), parts, F.col(f"{whole}_parity"))

    first, second = ("received", ("rejected", "duplicate", "accepted")), ("accepted", ("stored", "buried", "conflict"))
    checks = []
    for whole, parts in (first, second):
        same = (gap(whole, parts) == 0) & (gap(whole, parts, "_total") == 0) & (parity(whole, parts) == 0)
        checks += [gap(whole, parts).alias(f"{whole}_gap"), same.alias(f"{whole}_same")]
    return wide.select("source", "hour", *SIDES, *checks)
