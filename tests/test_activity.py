import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import T0
from quotemill.config import Source
from quotemill.operators import accounting, activity, segments
from quotemill.sources.registry import registry

TIMEOUTS = {"alpha": 5_000, "beta": 7_000, "delta": 5_000}


def random_feed(seed):
    rng = random.Random(seed)
    out = []
    for source in ("alpha", "beta"):
        clock = rng.randrange(10_000)
        for _ in range(300):
            clock += rng.choice([0, 10, 3_000, 4_999, 5_000, 5_001, 6_999, 7_000, 40_000, 30_000_000])
            out.append((source, clock))
    rng.shuffle(out)
    return out


@pytest.fixture
def feed(raw_rows, spark):
    def build(arrivals):
        raw = raw_rows([(s.upper(), "{}", ms / 1000, n) for n, (s, ms) in enumerate(arrivals)])
        return raw, registry(spark, [Source(s, "alpha-v1", t) for s, t in TIMEOUTS.items()])

    return build


def expected_sessions(arrivals):
    out = []
    for source in ("alpha", "beta"):
        times = sorted(ms for s, ms in arrivals if s == source)
        parts = [[times[0]]]
        for before, after in zip(times, times[1:]):
            if after - before >= TIMEOUTS[source]:
                parts.append([])
            parts[-1].append(after)
        out += [(source, n + 1, p[0], p[-1], len(p), n + 1 < len(parts)) for n, p in enumerate(parts)]
    return out


def ms(micros):
    return micros // 1000 - int(T0.timestamp() * 1000)


@pytest.mark.parametrize("seed", [1, 2])
def test_gaps_sessions_streaks(feed, seed):
    arrivals = random_feed(seed)
    raw, sources = feed(arrivals)
    expected = expected_sessions(arrivals)
    found = activity.sessions(raw, sources).cache()
    got = sorted(
        (r["source"], r["session_no"], ms(r["first_at"]), ms(r["last_at"]), r["messages"], r["ended"])
        for r in found.collect()
    )
    assert got == expected
    gaps = sorted((r["source"], ms(r["stalled_after"]), ms(r["resumed_at"])) for r in activity.idle_gaps(raw, sources).collect())
    assert gaps == sorted((a[0], a[3], b[2]) for a, b in zip(expected, expected[1:]) if a[0] == b[0])
    streaks, run = [], {}
    for source, no, first, last, _, ended in expected:
        if ended:
            stable = last - first + TIMEOUTS[source] >= 12_000
            run[source] = 1 if stable else min(run.get(source, 0) + 1, 3)
            streaks.append((source, no, run[source]))
    got = sorted((r["source"], r["session_no"], r["streak"]) for r in activity.flap_streaks(found, 12_000, 3).collect())
    assert got == streaks
    counts = {r["source"]: r["reconnects"] for r in activity.reconnects(found).collect()}
    assert counts == {s: sum(1 for e in expected if e[0] == s) - 1 for s in ("alpha", "beta")}


def test_health_states(feed):
    raw, sources = feed([("alpha", 0), ("beta", 0), ("beta", 5_000)])

    def at(millis):
        as_of = F.lit(int(T0.timestamp() * 1_000_000) + millis * 1000)
        live = activity.liveness(raw, sources, as_of)
        states = activity.state_map(activity.state_changes(activity.sessions(raw, sources, as_of))).first()[0]
        up = {r["source"]: r["connected"] for r in live.collect()}
        return up, activity.health(live).first()["status"], states

    up, status, states = at(4_999)
    assert up == {"alpha": True, "beta": True, "delta": False} and status == "degraded"
    up, _, states = at(5_000)
    assert up["alpha"] is False and states == {"alpha": False, "beta": True}


def test_segmented_totals_equal_one_window(spark):
    rows = [("a" if n % 3 else "b", n // 7, n, n * n % 11) for n in range(200)]
    df = spark.createDataFrame(rows, "k string, seg bigint, n bigint, v bigint")
    got = {r["n"]: r["total"] for r in segments.running_total(df, ["k"], "seg", ["n"], {"total": "v"}).collect()}
    sums = {"a": 0, "b": 0}
    for k, _, n, v in rows:
        sums[k] += v
        assert got[n] == sums[k]
    whole = segments.running_total(df, [], "seg", ["n"], {"total": "v"}).agg(F.max("total")).first()[0]
    assert whole == sum(r[3] for r in rows)
    before = {r["n"]: r["p"] for r in segments.previous_value(df, ["k"], "seg", ["n"], "n", "p").collect()}
    assert before[0] is None and before[3] == 0 and before[7] == 5 and before[199] == 197


def test_counters_and_balance(spark):
    parsed = spark.createDataFrame(
        [("alpha", "alpha", s) for s in ["valid"] * 5 + ["invalid"] * 2 + ["oversize"]],
        "source string, source_name string, status string",
    )
    loaded = spark.createDataFrame(
        [("alpha", o) for o in ("written", "written", "conflict", "dead_lettered")], "source string, outcome string"
    )
    counts = accounting.by_source(parsed, loaded)
    row = counts.first().asDict()
    assert row == {"source": "alpha", "raw": 7, "invalid": 2, "duplicate": 1, "accepted": 4, "written": 2,
                   "conflict": 1, "dead_lettered": 1, "dropped": 0, "oversize": 1}
    assert accounting.reconcile(counts).first()["balanced"]
    reconnects = spark.createDataFrame([("alpha", 3)], "source string, reconnects bigint")
    failed = spark.createDataFrame([("alpha", 0), ("beta", 4)], "source string, batch_no bigint")
    row = accounting.snapshot(counts, reconnects, failed).first()
    assert (row["reconnects_scheduled"], row["database_write_attempt_failures"]) == (3, 2)


def test_window_moves_with_midnight(feed):
    day = 86_400_000
    arrivals = [("alpha", day // 2 + d) for d in (-2_000, -1, 0, 1, 4_000, 9_001)]
    raw, sources = feed(arrivals)
    assert [r["messages"] for r in activity.sessions(raw, sources).orderBy("session_no").collect()] == [5, 1]
    assert T0 + timedelta(hours=12) == T0.replace(day=2, hour=0)
