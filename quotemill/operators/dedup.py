"""Windowed de-duplication by arrival time, in-batch first-wins, live keys.

The rule: the first arrival of an id is accepted and opens a window of fixed length. Arrivals inside the window are
duplicates and do not extend it; the first arrival at or after its end is accepted and opens the next window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as fv
from ..functions.moments import floor_div
from ..schemas import ARRIVAL, CONTENT
from ..session import materialize

# Above this many arrivals an id is not folded in memory but chained with joins.
FOLD_LIMIT = 1_000
# Parts of a window whose instants one task compares, and parts in a range
SLOTS = 64
RANGE_SLOTS = 4_096


def _micros(column: str | Column) -> Column:
    return F.unix_micros(column)


def arrival_spans(ticks: DataFrame) -> DataFrame:
    """Per id its content, first arrival (``received_at``, ``seq``), ``last_at`` and number of ``arrivals``.

    Arrival and sequence number travel as one decimal that is ordered like the pair. Its buffer has a fixed length, so
    ticks are hashed; the minimum of a struct would have them sorted before and after the shuffle. The arrival has a
    minimum of its own, so that unpacking is a subtraction: divisions of such decimals cost more than all else here.
    """
    arrival = "cast(unix_micros(received_at) as decimal(19,0)) * 100000000000000000000BD"
    # 20 digits hold a sequence number moved to above zero; zero stands for none
    packed = F.expr(f"{arrival} + coalesce(cast(seq as decimal(20,0)) + 10000000000000000000BD, 0BD)")
    # The other content columns depend on the id, so grouping by them as well does not split a group.
    found = ticks.groupBy(*CONTENT).agg(
        F.min(packed).alias("_first"), F.min("received_at").alias("received_at"), F.max("received_at").alias("last_at"),
        F.count(F.lit(1)).alias("arrivals"),
    )
    place = found.withColumn("_place", F.expr(f"_first - {arrival}"))
    return place.select(
        *CONTENT,
        "received_at",
        F.expr("case when _place > 0 then cast(_place - 10000000000000000000BD as bigint) end").alias("seq"),
        "last_at",
        "arrivals",
    )


def accept(ticks: DataFrame, window_ms: int = fv.DEDUP_WINDOW_MS, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """The accepted ticks, one row per opened window.

    1. One aggregate per id finds its first and last arrival. Copies collapse before the shuffle, so an id with very
       many copies costs one row per task. Ids whose arrivals all lie inside one window end here.
    2. The other ids are few. Those with at most ``fold_limit`` arrivals are folded in arrival order.
    3. Ids with more arrivals are chained across tasks, see :func:`_chain`.
    """
    window = window_ms * 1000
    spans = materialize(arrival_spans(ticks), "dedup-spans")
    reaches = _micros("last_at") >= _micros("received_at") + window
    accepted = spans.filter(~reaches).select(*CONTENT, *ARRIVAL)
    # Stored, so that their size is known: while they are small enough to broadcast, the ticks are not shuffled again.
    long_ids = materialize(spans.filter(reaches).select("id", "arrivals"), "dedup-long")
    counts = long_ids.agg(
        F.count(F.lit(1)).alias("ids"), F.count(F.when(F.col("arrivals") > fold_limit, 1)).alias("hot")
    ).first()
    if counts["ids"] > counts["hot"]:
        rows = ticks.join(long_ids.filter(F.col("arrivals") <= fold_limit).select("id"), "id", "left_semi")
        accepted = accepted.unionByName(materialize(_fold(rows, window), "dedup-folded"))
    if counts["hot"]:
        rows = ticks.join(long_ids.filter(F.col("arrivals") > fold_limit).select("id"), "id", "left_semi")
        accepted = accepted.unionByName(materialize(_chain(rows, window), "dedup-chained"))
    return accepted


def _fold(ticks: DataFrame, window: int) -> DataFrame:
    """Walk the sorted arrivals of each id; only for ids with a bounded number of arrivals."""
    arrivals = ticks.groupBy(*CONTENT).agg(
        F.array_sort(F.collect_list(F.struct(_micros("received_at").alias("at"), "received_at", "seq"))).alias("arrivals")
    )
    state = "struct<until:bigint,kept:array<struct<at:bigint,received_at:timestamp,seq:bigint>>>"
    start = F.struct(F.lit(None).alias("until"), F.array().alias("kept")).cast(state)

    def step(state_so_far: Column, arrival: Column) -> Column:
        opens = state_so_far.until.isNull() | (arrival["at"] >= state_so_far.until)
        opened = F.struct(
            (arrival["at"] + window).alias("until"), F.concat(state_so_far.kept, F.array(arrival)).alias("kept")
        )
        return F.when(opens, opened).otherwise(state_so_far)

    return (
        arrivals.withColumn("kept", F.aggregate("arrivals", start, step).kept)
        .select(*CONTENT, F.explode("kept").alias("anchor"))
        .select(*CONTENT, "anchor.received_at", "anchor.seq")
    )


def _chain(ticks: DataFrame, window: int) -> DataFrame:
    """The same rule for ids of any size, without a task that holds all arrivals of an id.

    Every arrival instant gets a pointer to the instant that would open the next window. The pointers are found per
    (id, slot), where a slot is a small part of the window, and followed by doubling: after round n the first 2^n
    accepted instants of each id are known. The rounds grow with the logarithm of the accepted count.
    """
    points = materialize(
        ticks.groupBy(*CONTENT, _micros("received_at").alias("at")).agg(F.min("seq").alias("seq")), "dedup-points"
    )
    jumps = materialize(_next_points(points.select("id", "at"), window), "dedup-jumps")
    anchors = materialize(points.groupBy("id").agg(F.min("at").alias("at")), "dedup-anchors")
    newest = anchors
    while True:
        # ``anchors`` holds the first 2^n accepted instants, so their 2^n-th successors are all new.
        found = anchors.join(jumps, ["id", "at"]).select("id", F.col("next_at").alias("at"))
        newest = materialize(found, "dedup-anchors")
        if newest.isEmpty():
            break
        anchors = anchors.unionByName(newest)
        ahead = jumps.select("id", F.col("at").alias("next_at"), F.col("next_at").alias("far_at"))
        jumps = materialize(
            jumps.join(ahead, ["id", "next_at"]).select("id", "at", F.col("far_at").alias("next_at")), "dedup-jumps"
        )
    return points.join(anchors, ["id", "at"], "left_semi").select(
        *CONTENT, F.timestamp_micros("at").alias("received_at"), "seq"
    )


def _next_points(points: DataFrame, window: int) -> DataFrame:
    """(id, at, next_at) for ``points(id, at)``: the first instant at least one window after each instant.

    Instants shifted by one window meet the real instants of their slot. Walking back in time, the latest real instant
    passed is the earliest one that is not before the shifted instant. A slot without one takes the first instant of a
    later slot. A task holds the instants of a slot, the slots of a range, or the ranges of an id, which are a row each.
    """
    slot = floor_div(F.col("point"), max(1, window // SLOTS))
    real = points.select("id", F.col("at").alias("point"), F.lit(None).cast("bigint").alias("from_at"),
                         F.col("at").alias("real_at"), F.lit(0).alias("rank"))
    shifted = points.select("id", (F.col("at") + window).alias("point"), F.col("at").alias("from_at"),
                            F.lit(None).cast("bigint").alias("real_at"), F.lit(1).alias("rank"))
    both = shifted.unionByName(real).withColumn("slot", slot)
    slots = materialize(
        both.groupBy("id", "slot").agg(F.min("real_at").alias("first_at"))
        .withColumn("range", floor_div(F.col("slot"), RANGE_SLOTS)),
        "dedup-slots",
    )
    later_slots = Window.partitionBy("id", "range").orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    later_ranges = Window.partitionBy("id").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = slots.groupBy("id", "range").agg(F.min("first_at").alias("first_at")).select(
        "id", "range", F.min("first_at").over(later_ranges).alias("_beyond")
    )
    later = (
        slots.withColumn("_inside", F.min("first_at").over(later_slots))
        .join(ranges, ["id", "range"])
        .select("id", "slot", F.coalesce("_inside", "_beyond").alias("later_at"))
    )
    backwards = (
        Window.partitionBy("id", "slot").orderBy(F.desc("point"), "rank")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        both.withColumn("met_at", F.min("real_at").over(backwards))
        .filter(F.col("from_at").isNotNull())
        .join(later, ["id", "slot"])
        .select("id", F.col("from_at").alias("at"), F.coalesce("met_at", "later_at").alias("next_at"))
        .filter(F.col("next_at").isNotNull())
    )


def accept_after(ticks: DataFrame, anchors: DataFrame, window_ms: int = fv.DEDUP_WINDOW_MS,
                 fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """The accepted ticks of a later batch, given earlier ``anchors(id, anchor_at)``.

    Arrivals before the end of an id's open window are duplicates. What remains starts afresh, so the plain rule
    decides the rest.
    """
    open_until = anchors.groupBy("id").agg((F.max(_micros("anchor_at")) + window_ms * 1000).alias("open_until"))
    free = (
        ticks.join(open_until, "id", "left")
        .filter(F.col("open_until").isNull() | (_micros("received_at") >= F.col("open_until")))
        .drop("open_until")
    )
    return accept(free, window_ms, fold_limit)


def mark(ticks: DataFrame, accepted: DataFrame) -> DataFrame:
    """Every tick with ``is_duplicate``; joined on id and arrival, so copies of one id spread over tasks.

    Of ticks that share id, arrival and sequence number, one is the accepted one."""
    flags = accepted.select("id", *ARRIVAL, F.lit(True).alias("_opens"))
    nth = F.row_number().over(Window.partitionBy("id", *ARRIVAL).orderBy(F.lit(0)))
    joined = ticks.withColumn("_nth", nth).join(flags, ["id", *ARRIVAL], "left")
    first = F.coalesce("_opens", F.lit(False)) & (F.col("_nth") == 1)
    return joined.select(*ticks.columns, (~first).alias("is_duplicate"))


def suppressed(ticks: DataFrame, accepted: DataFrame, window_ms: int = fv.DEDUP_WINDOW_MS) -> DataFrame:
    """The ticks that an open window explains: not accepted, and an accepted copy arrived less than a window before.

    Counted without the rule itself, so a tick that is neither accepted nor explained shows up in the balance. The
    join is on id and window-long cells, in which an id has two anchors at most."""
    window = window_ms * 1000
    cell = F.expr(f"unix_micros(received_at) div {window}")
    rest = mark(ticks, accepted).filter("is_duplicate").drop("is_duplicate").withColumn("_cell", cell)
    anchors = accepted.select("id", _micros("received_at").alias("_anchor"), F.explode(F.array(cell, cell + 1)).alias("_cell"))
    elapsed = _micros("received_at") - F.col("_anchor")
    explained = rest.join(anchors, ["id", "_cell"]).filter((elapsed >= 0) & (elapsed < window))
    return explained.select(*ticks.columns)


def first_per_id(ticks: DataFrame) -> DataFrame:
    """Of several rows with one id, the earliest arrival. Ranked per task first, so a hot id does not travel."""
    order = Window.partitionBy("id").orderBy(*ARRIVAL)
    return ticks.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def live_keys(accepted: DataFrame, as_of: Column, window_ms: int = fv.DEDUP_WINDOW_MS) -> DataFrame:
    """Number of ids whose window is open at ``as_of``. Windows of one id never overlap, so rows count ids."""
    arrived = _micros("received_at")
    now = _micros(as_of)
    return accepted.filter((arrived <= now) & (arrived > now - window_ms * 1000)).agg(
        F.count(F.lit(1)).alias("live_keys")
    )


# HyperLogLog registers are 2^SKETCH_BITS; the relative standard error of an estimate is 1.04 / sqrt(2^SKETCH_BITS) = 1.6 %
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def key_sketches(accepted: DataFrame, interval_ms: int) -> DataFrame:
    """One mergeable sketch of the ids per source and interval of arrival: a few kilobytes, whatever the number of ids.

    Sketches of intervals, of micro-batches or of sources merge into those of their union (:func:`estimated_keys`)."""
    at = floor_div(_micros("received_at"), interval_ms * 1000)
    return accepted.groupBy("source", at.alias("interval")).agg(F.hll_sketch_agg("id", SKETCH_BITS).alias("sketch"))


def estimated_keys(sketches: DataFrame, *groups: str | Column) -> DataFrame:
    """Distinct ids of all sketches of a group, with the error stated at ``SKETCH_ERROR``; ids in several count once."""
    return sketches.groupBy(*groups).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("keys"))
