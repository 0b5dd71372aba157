import random
import re
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import T0
from quotemill.operators import dedup

SCHEMA = (
    "id string, symbol string, price decimal(38,18), volume decimal(38,18), event_time timestamp, event_ticks bigint, "
    "source string, received_at timestamp, seq bigint"
)


def ticks(spark, arrivals):
    rows = [
        (i, "A", Decimal(1), Decimal(1), T0, 1, "alpha", T0 + timedelta(milliseconds=ms), seq) for i, ms, seq in arrivals
    ]
    return spark.createDataFrame(rows, SCHEMA)


def brute(arrivals, window, anchors=None):
    open_from, kept = dict(anchors or {}), []
    for i, ms, seq in sorted(arrivals, key=lambda a: (a[1], a[2])):
        if i not in open_from or ms - open_from[i] >= window:
            open_from[i] = ms
            kept.append((i, ms, seq))
    return sorted(kept)


def found(df):
    return sorted(
        (r["id"], round((r["received_at"].timestamp() - T0.timestamp()) * 1000), r["seq"]) for r in df.collect()
    )


def test_window_is_anchored_at_the_accepted_arrival(spark):
    seconds = [0, 5, 9, 10, 12, 21]
    arrivals = [("x", s * 1000, n) for n, s in enumerate(seconds)]
    assert [ms // 1000 for _, ms, _ in found(dedup.accept(ticks(spark, arrivals), 10_000))] == [0, 10, 21]


def test_many_copies_accept_one(spark):
    assert len(found(dedup.accept(ticks(spark, [("x", 0, n) for n in range(10_000)]), 10_000))) == 1


def random_arrivals(seed):
    rng = random.Random(seed)
    out, seq = [], 0
    for i in range(30):
        clock = rng.randrange(50_000)
        for _ in range(rng.choice([1, 2, 5, 40])):
            clock += rng.choice([0, 1, 500, 999, 1000, 1001, 2500, 9_999, 10_000, 10_001, 35_000])
            out.append((f"id{i}", clock, seq))
            seq += 1
    # one id with a third of all rows, in steps shorter than the window
    for n in range(len(out) // 2):
        out.append(("hot", n * 700 + rng.randrange(700), seq))
        seq += 1
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("fold_limit", [10_000, 20, 0])
def test_equals_brute_force(spark, fold_limit):
    arrivals = random_arrivals(fold_limit)
    got = found(dedup.accept(ticks(spark, arrivals), 10_000, fold_limit))
    assert got == brute(arrivals, 10_000)


@pytest.mark.parametrize(("slots", "range_slots"), [(1, 1), (7, 3), (64, 2), (20_000_000, 5)])
def test_chains_over_slots_and_ranges_equal_brute_force(spark, monkeypatch, slots, range_slots):
    monkeypatch.setattr(dedup, "SLOTS", slots)
    monkeypatch.setattr(dedup, "RANGE_SLOTS", range_slots)
    arrivals = random_arrivals(slots)
    assert found(dedup.accept(ticks(spark, arrivals), 10_000, 0)) == brute(arrivals, 10_000)


def test_no_task_of_a_chain_holds_the_instants_of_an_id(spark):
    points = spark.range(50_000).selectExpr("'hot' as id", "id * 40000 as at")
    jumps = dedup._next_points(points, 10_000_000)
    assert jumps.filter("next_at <> at + 10000000").isEmpty() and jumps.count() == 50_000 - 250
    width = 10_000_000 // dedup.SLOTS
    held = points.groupBy(dedup.floor_div(F.col("at"), width)).count().agg(F.max("count")).first()[0]
    assert held <= 4
    specs = set(re.findall(r"windowspecdefinition\((id#\d+(?:, \w+#\d+L?)?)", jumps._jdf.queryExecution().optimizedPlan().toString()))
    assert len(specs) == 3  # the instants of a slot, the slots of a range, and one row per range


def test_chain_takes_logarithmic_rounds(spark, monkeypatch):
    arrivals = [("hot", n * 100, n) for n in range(6_000)]
    rounds = []
    plain = dedup.materialize
    monkeypatch.setattr(dedup, "materialize", lambda df, label: rounds.append(label) or plain(df, label))
    got = found(dedup.accept(ticks(spark, arrivals), 10_000, 0))
    assert got == brute(arrivals, 10_000) and len(got) == 60
    assert rounds.count("dedup-jumps") <= 8


def test_later_batch_respects_earlier_anchors(spark):
    arrivals = [("x", s * 1000, n) for n, s in enumerate([3, 9, 10, 12, 19, 20, 31])] + [("y", 4000, 100)]
    anchors = spark.createDataFrame(
        [("x", T0), ("x", T0 - timedelta(seconds=30)), ("z", T0)], "id string, anchor_at timestamp"
    )
    got = found(dedup.accept_after(ticks(spark, arrivals), anchors, 10_000))
    assert got == brute(arrivals, 10_000, {"x": 0})


def test_mark_first_and_live(spark):
    arrivals = [("x", 0, 1), ("x", 0, 2), ("x", 5_000, 3), ("x", 10_000, 4), ("y", 9_000, 5)]
    all_ticks = ticks(spark, arrivals)
    accepted = dedup.accept(all_ticks, 10_000)
    marks = {r["seq"]: r["is_duplicate"] for r in dedup.mark(all_ticks, accepted).collect()}
    assert marks == {1: False, 2: True, 3: True, 4: False, 5: False}
    assert sorted(r["seq"] for r in dedup.first_per_id(all_ticks).collect()) == [1, 5]

    def live(seconds):
        return dedup.live_keys(accepted, F.lit(T0 + timedelta(seconds=seconds)), 10_000).first()[0]

    assert [live(0), live(9), live(10), live(19), live(20)] == [1, 2, 2, 1, 0]


def test_hot_ids_are_reduced_before_the_shuffle(spark):
    plan = dedup.first_per_id(ticks(spark, [("x", 0, 1)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_a_lost_tick_leaves_a_gap(spark, raw_rows):
    from quotemill.operators import accounting

    at = [datetime(2026, 6, 1, 12, 0, s, tzinfo=timezone.utc) for s in (0, 1, 2, 30)]
    ticks = spark.createDataFrame(
        [("a", "alpha", at[0], 0), ("a", "alpha", at[1], 1), ("a", "alpha", at[1], 1), ("b", "alpha", at[2], 2), ("a", "alpha", at[3], 3)],
        "id string, source string, received_at timestamp, seq bigint",
    )
    accepted = ticks.filter("seq in (0, 2, 3)")
    assert dedup.suppressed(ticks, accepted, 10_000).count() == 2
    parsed = ticks.selectExpr("source", "source as source_name", "'valid' as status")

    def gap(kept):
        loaded = kept.selectExpr("source", "'written' as outcome")
        counts = accounting.by_source(parsed, loaded, dedup.suppressed(ticks, kept, 10_000))
        return accounting.reconcile(counts).first()["received_gap"]

    assert gap(accepted) == 0 and gap(accepted.filter("seq <> 2")) == 1 and gap(accepted.filter("seq <> 3")) == 1


def test_mark_leaves_one_accepted_row_per_window(spark):
    at = datetime(2026, 6, 1, 12, 0, 0, tzinfo=timezone.utc)
    ticks = spark.createDataFrame([("a", at, 0), ("a", at, 0)], "id string, received_at timestamp, seq bigint")
    assert sorted(r.is_duplicate for r in dedup.mark(ticks, ticks.limit(1)).collect()) == [False, True]


def test_spans_are_hashed_and_ordered_by_arrival_then_sequence(spark):
    at = [datetime(y, 6, 1, 12, 0, 0, 1, tzinfo=timezone.utc) for y in (1960, 2026, 9998)]
    low, high = -(2**63), 2**63 - 1
    rows = [("a", at[1], high), ("a", at[1], low), ("a", at[2], 0), ("b", at[0], 5), ("b", at[1], 1), ("c", at[2], None),
            ("c", at[2], 3), ("d", at[2], high)]
    content = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "n int, id string, received_at timestamp, seq bigint")
    named = content.selectExpr(
        "id", "id as symbol", "1.5BD as price", "2BD as volume", "timestamp'2026-01-01' as event_time", "0L as event_ticks",
        "'alpha' as source", "received_at", "seq",
    )
    spans = dedup.arrival_spans(named)
    found = {r["id"]: (r["micros"], r["seq"], r["arrivals"]) for r in spans.selectExpr("id", "unix_micros(received_at) as micros", "seq", "arrivals").collect()}
    micros = [(t - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1) for t in at]
    assert found == {"a": (micros[1], low, 3), "b": (micros[0], 5, 2), "c": (micros[2], None, 2), "d": (micros[2], high, 1)}
    plan = spans._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_few_long_ids_are_folded_without_a_shuffle_of_the_ticks(spark, monkeypatch):
    held = {}

    def stored(df, label):
        held[label] = df._jdf.queryExecution().executedPlan().toString()
        return plain(df, label)

    plain = dedup.materialize
    monkeypatch.setattr(dedup, "materialize", stored)
    rows = spark.range(20_000).selectExpr(
        "sha2(cast(if(id < 3, 0, id) as string), 256) as id", "'A' as symbol", "cast(1 as decimal(38,18)) as price",
        "cast(1 as decimal(38,18)) as volume", "timestamp'2026-06-01' as event_time", "1L as event_ticks", "'alpha' as source",
        "timestamp_seconds(id * 200) as received_at", "id as seq",
    )
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        accepted = dedup.accept(plain(rows, "ticks"), 120_000)
        assert accepted.count() == 20_000 and accepted.select("id").distinct().count() == 19_998
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin" in held["dedup-folded"] and "SortMergeJoin" not in held["dedup-folded"]


def test_spans_are_unpacked_without_a_division(spark):
    plan = dedup.arrival_spans(ticks(spark, [("x", 0, 1)]))._jdf.queryExecution().executedPlan().toString()
    assert " div " not in plan and "pmod" not in plan
