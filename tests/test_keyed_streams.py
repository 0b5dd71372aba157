"""Streams with keyed state, observed counters and the audit of stored tables."""

import random
import time
from collections import Counter, defaultdict
from datetime import timedelta
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import T0
from quotemill.config import DEFAULT_SOURCES, Options, Source
from quotemill.operators import access, activity, audit, compaction, dedup, load, normalize, sequence
from quotemill.session import work_folder
from quotemill.sources import feeds
from quotemill.sources.registry import registry
from quotemill.streaming import metrics, observed, watermarked
from quotemill.streaming.ingest import Ingest
from test_stream import beta, part

START = int(T0.timestamp()) * 1_000_000


def land(spark, raw_rows, batches, make, keys):
    """Results of a stream after each batch came in a run of its own."""
    root, landing = work_folder(spark, "keyed"), work_folder(spark, "landing")
    found = None
    for rows in batches:
        raw_rows(rows).repartition(3).write.mode("append").parquet(landing)
        stream = make(feeds.stream_messages(spark, landing))
        found = metrics.run_in_parts(stream, lambda r: r, f"{root}/rows", f"{root}/checkpoint")
    return watermarked.current(found, keys).collect()


def disordered(seed):
    """Batches of (source, payload, second) whose seconds mostly grow; some come much too late, some sources lag."""
    rng = random.Random(seed)
    batches = []
    for n in range(6):
        rows = []
        for source, lag in (("alpha", 0), ("beta", 5000), ("gamma", 0)):
            if source == "gamma" and n % 2:
                continue
            for _ in range(rng.randint(1, 30)):
                late = rng.choice([0, 0, 0, 40, 900, 4000])
                rows.append((source, "{x", n * 1000 + rng.randint(0, 999) - late - lag))
        batches.append(rows)
    return batches


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_close_once_and_every_message_is_closed_open_or_late(spark, raw_rows, sources, seed):
    batches = disordered(seed)
    got = land(spark, raw_rows, batches, lambda s: watermarked.tumbling_counts(s, sources, 60_000, 300_000), ["at"])
    expected, newest = Counter(), {}
    held = defaultdict(Counter)
    for rows in batches:
        before = dict(newest)
        for source, _, second in rows:
            end = (second // 60 + 1) * 60
            if source in before and end <= before[source] - 300:
                expected[source, "late", end] += 1
            else:
                held[source][end] += 1
                newest[source] = max(second, newest.get(source, second))
        for source, ends in held.items():
            for end in [e for e in ends if e <= newest[source] - 300]:
                expected[source, "closed", end] += ends.pop(end)
    for source, ends in held.items():
        for end, n in ends.items():
            expected[source, "open", end] += n
    assert {(r.source, r.kind, (r["at"] - START) // 10**6): r.messages for r in got} == expected
    assert sum(r.messages for r in got) == sum(map(len, batches))
    assert {kind for _, kind, _ in expected} == {"late", "closed", "open"}


@pytest.mark.parametrize("seed", [3, 4])
def test_sessions_close_behind_the_watermark(spark, raw_rows, seed):
    batches = disordered(seed)
    slow = registry(spark, [Source(s.name, s.format, 120_000) for s in DEFAULT_SOURCES])
    got = land(spark, raw_rows, batches, lambda s: watermarked.session_activity(s, slow, 300_000), ["first_at", "last_at"])
    expected, held, newest = Counter(), defaultdict(list), {}
    for rows in batches:
        cells = defaultdict(list)
        for source, _, second in rows:
            cells[source, (second + START // 10**6) // 120].append(second)
        before = dict(newest)
        for (source, _), seconds in cells.items():
            first, last = min(seconds), max(seconds)
            if source in before and last + 120 <= before[source] - 300:
                expected[source, "late", first, last] += len(seconds)
            else:
                held[source] += seconds
                newest[source] = max(last, newest.get(source, last))
        for source in held:
            spans = []
            for second in sorted(held[source]):
                if spans and second - spans[-1][-1] < 120:
                    spans[-1].append(second)
                else:
                    spans.append([second])
            held[source] = []
            for span in spans:
                if span[-1] + 120 <= newest[source] - 300:
                    expected[source, "closed", span[0], span[-1]] += len(span)
                else:
                    held[source] += span
    for source, seconds in held.items():
        for second in sorted(seconds):
            expected[source, "open", second] += 1
    found = Counter()
    for r in got:
        first, last = (int((t - START) // 10**6) for t in (r.first_at, r.last_at))
        found[(r.source, r.kind, first, last) if r.kind != "open" else (r.source, "open")] += r.messages
    opened = Counter()
    for key, n in list(expected.items()):
        if key[1] == "open":
            opened[key[:2]] += expected.pop(key)
    assert found == expected + opened
    assert sum(found.values()) == sum(map(len, batches))


def test_a_silent_source_goes_down_without_a_message(spark, raw_rows):
    """Beta sends on while alpha is silent; then alpha comes back, and both stop."""
    root, landing = work_folder(spark, "stalls"), work_folder(spark, "landing")
    quick = registry(spark, [Source("alpha", "alpha-v1", 2500), Source("beta", "beta-v1", 60_000)])
    raw_rows([("alpha", "{x", 0), ("alpha", "{x", 1), ("beta", beta("A"), 0)]).coalesce(1).write.parquet(landing)
    changes = watermarked.connection_changes(feeds.stream_messages(spark, landing), quick)
    query = metrics.start_parts(changes, lambda rows: rows, f"{root}/rows", f"{root}/checkpoint", "1500 milliseconds", True)

    def read():
        return [] if not metrics.has_parts(spark, f"{root}/rows") else sorted((r.messages, r.by_timer, r.source, r.connected) for r in metrics.read_parts(spark, f"{root}/rows").collect())

    def wait(n):
        until = time.monotonic() + 90
        while time.monotonic() < until and len(read()) < n:
            time.sleep(0.3)
        return read()

    try:
        down = [(2, True, "alpha", False)]
        assert wait(3) == sorted([(1, False, "beta", True), (2, False, "alpha", True), *down])
        raw_rows([("alpha", "{x", 9), ("beta", beta("A"), 9)]).coalesce(1).write.mode("append").parquet(landing)
        back = [(3, False, "alpha", True), (3, True, "alpha", False)]
        assert wait(5) == sorted([(1, False, "beta", True), (2, False, "alpha", True), *down, *back])
        states = {r.source: r.connected for r in watermarked.last_states(metrics.read_parts(spark, f"{root}/rows")).collect()}
        assert states == {"alpha": False, "beta": True}
    finally:
        metrics.stop_between_batches(query)


def test_a_task_sums_any_number_of_batches():
    names = ["timeout", "cell", "first_at", "last_at", "messages"]
    schema = pa.schema([pa.field("source", pa.string(), False), *[pa.field(n, pa.int64(), n == "cell") for n in names]])
    batches = [
        pa.RecordBatch.from_pylist([{"source": s, "timeout": 5, "cell": n % 3, "first_at": n, "last_at": n + 1, "messages": 1}
                                    for s in ("alpha", "beta")], schema=schema)
        for n in range(40)
    ]
    found = [row for batch in watermarked._summed(iter(batches)) for row in batch.to_pylist()]
    assert sorted((r["source"], r["cell"], r["first_at"], r["last_at"], r["messages"]) for r in found) == [
        (s, cell, cell, last, count) for s in ("alpha", "beta") for cell, last, count in ((0, 40, 14), (1, 38, 13), (2, 39, 13))
    ]


def test_a_folder_of_results_never_disappears_while_a_timer_stream_runs(spark, raw_rows):
    root, landing = work_folder(spark, "stalls"), work_folder(spark, "landing")
    raw_rows([("alpha", "{x", 1), ("beta", "{x", 2)]).write.parquet(landing)
    timed = registry(spark, [Source(s.name, s.format, 1_500) for s in DEFAULT_SOURCES])
    changes = watermarked.connection_changes(feeds.stream_messages(spark, landing), timed)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # short batches
    query = metrics.start_parts(changes, lambda rows: rows, f"{root}/rows", f"{root}/checkpoint", "2 seconds", True)
    seen, until = set(), time.monotonic() + 60
    try:
        # batches without rows come between and after the two with rows
        while time.monotonic() < until and len(query.recentProgress) < 4:
            seen.update(Path(root, "rows").glob("run=*/part=*"))
            time.sleep(0.002)
    finally:
        metrics.stop_between_batches(query)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert seen and all(folder.exists() for folder in seen)
    assert not list(Path(f"{root}/rows-staged").glob("run=*/part=*"))
    assert metrics.read_parts(spark, f"{root}/rows").count() == 4


def test_a_second_checkpoint_keeps_the_metrics_of_the_first(spark, raw_rows, sources):
    root = work_folder(spark, "metrics")
    beats = cells = None
    for n in range(2):
        landing = work_folder(spark, "landing")
        raw_rows([("alpha", "{x", 10 * i + n) for i in range(10)] + [("beta", beta("A"), 100 * n)]).coalesce(1).write.parquet(landing)
        stream = feeds.stream_messages(spark, landing)
        parsed = normalize.parse(stream, sources)
        beats = metrics.run_in_parts(parsed, metrics.heartbeat_part, f"{root}/beats", f"{root}/beats-{n}")
        cells = metrics.run_in_parts(stream, lambda r: activity.arrivals(r, sources), f"{root}/cells", f"{root}/cells-{n}")
    assert metrics.heartbeat_counts(beats).agg(F.sum("raw"), F.sum("invalid"), F.sum("valid")).first()[:] == (22, 20, 2)
    assert metrics.session_activity(cells).agg(F.sum("messages")).first()[0] == 22


def test_observed_counters_need_no_job_of_their_own(spark, raw_rows, sources):
    root, landing = work_folder(spark, "observed"), work_folder(spark, "landing")
    raw_rows([("Beta", beta("A"), 0), ("beta", "{x", 1), ("beta", beta("B"), 2, 2, "binary"), ("gamma", "{x", 3),
              ("alpha", " " * 70_000, 4), ("unknown", "{x", 5)]).repartition(3).write.parquet(landing)
    listener = observed.Counters()
    seen = []
    for n in range(2):
        parsed = normalize.parse(feeds.stream_messages(spark, landing), sources)
        query = observed.counted(
            parsed, DEFAULT_SOURCES, lambda rows: rows.select("seq"), f"{root}/rows", f"{root}/checkpoint", listener
        )
        listener.wait_for(query)
        spark.streams.removeListener(listener)
        seen.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(query.runId))))
    got = {tuple(r) for r in listener.totals(spark).collect()}
    assert got == {("beta", 3, 2, 0, 1), ("gamma", 1, 1, 0, 0), ("alpha", 0, 0, 1, 0)}
    # the broadcast of the registry and the write; nothing in the second run, as nothing new has come
    assert listener.batches() == 1 and seen[0] <= 2 and seen[1] == 0


def audited(spark, raw, sources, job):
    rows = audit.balance(job.fingerprints(normalize.parse(raw, sources))).collect()
    return {r.source: r for r in rows}


def test_audit_sees_a_lost_a_doubled_and_a_changed_row(spark, raw_rows, sources):
    rows = [("beta", beta(f"S{i % 7}", n=i % 7), 3 * i, i) for i in range(60)]
    rows += [("beta", "{x", 5, 100), ("alpha", "{y", 5, 101), ("beta", beta("Y" * 40), 7, 102), ("beta", beta("S0"), 0, 103)]
    raw = raw_rows(rows)
    root = work_folder(spark, "audit")
    job = Ingest(root, options=Options(dedup_window_ms=10_000, batch_size=10), ledger_hours=None)
    for n in range(3):
        job.process(part(raw, n * 70, n * 70 + 70), n, "run")
    good = audited(spark, raw, sources, job)
    assert all(r.received_same and r.accepted_same and r.received_gap == r.accepted_gap == 0 for r in good.values())
    r = good["beta"]
    assert (r.received, r.rejected, r.buried) == (63, 1, 1) and r.stored and r.conflict and r.duplicate
    assert good["alpha"].rejected == good["alpha"].received == 1

    stored = load.read_table(spark, f"{root}/ticks")
    one = stored.orderBy("id").limit(1)

    def with_stored(frame):
        args = (normalize.parse(raw, sources), spark.read.parquet(f"{root}/rejected"), job.ledger(spark).select("id", "anchor_at"),
                frame, spark.read.schema("tick struct<id:string,source:string,received_at:timestamp>").json(f"{root}/dead_letter"))
        return {r.source: r for r in audit.balance(audit.outputs(*args, 10_000)).collect()}["beta"]

    assert with_stored(stored).accepted_same
    lost = with_stored(stored.join(one.select("id"), "id", "left_anti"))
    doubled = with_stored(stored.unionByName(one))
    moved = with_stored(stored.withColumn("received_at", F.when(F.col("id") == one.first()["id"], F.col("received_at") + timedelta(seconds=1))
                                          .otherwise(F.col("received_at"))))
    assert lost.accepted_gap > 0 and not lost.accepted_same
    assert doubled.accepted_gap == -1 and not doubled.accepted_same
    assert not moved.accepted_same
    assert lost.received_same and doubled.received_same
    # one lost and another doubled leave the count right, but not the sums
    other = stored.orderBy(F.desc("id")).limit(1)
    swapped = with_stored(stored.join(one.select("id"), "id", "left_anti").unionByName(other))
    assert not swapped.accepted_same


def test_heartbeat_line_at_the_edges(spark, raw_rows):
    """Beats of 10 s, windows of 20 s, timeout of 5 s: what ends at a beat has ended, what begins there has not."""
    rows = [("beta", beta("A"), 0), ("beta", beta("B"), 9), ("beta", "{x", 10), ("beta", beta("A"), 20, 50), ("gamma", "{x", 25)]
    configured = [Source("beta", "beta-v1", 5_000), Source("gamma", "gamma-v1", 5_000), Source("Quiet", "alpha-v1", 5_000)]
    table = registry(spark, configured)
    raw = raw_rows(rows)
    parsed = normalize.parse(raw, table)
    accepted = normalize.ticks(parsed).withColumn("batch_no", F.lit(0)).withColumn("failure", F.lit(None).cast("string"))
    loaded = accepted.withColumn("outcome", F.when(F.col("seq") == 50, "conflict").otherwise("written"))
    found = activity.sessions(raw, table)
    got = activity.heartbeat_line(parsed, loaded, found, [s.name for s in configured], 10_000, 20_000).orderBy("at").collect()
    assert [(r["at"] - START) // 10**6 for r in got] == [10, 20, 30]
    assert [(r.raw, r.accepted, r.duplicate, r.invalid, r.written, r.conflicts) for r in got] == [
        (2, 2, 0, 0, 2, 0), (3, 2, 0, 1, 2, 0), (5, 3, 0, 2, 2, 1)
    ]
    # A is live until 20 and again from 20 to 40, B until 29
    assert [r.live_keys for r in got] == [2, 1, 1]
    # beta stalls at 5, 15 and 25; gamma at 30; beta reconnects at 9 and 20
    assert [r.sources for r in got] == ["beta=up,gamma=down,quiet=down", "beta=down,gamma=down,quiet=down",
                                        "beta=down,gamma=down,quiet=down"]
    assert [r.reconnects for r in got] == [1, 1, 2]


def test_oversize_messages_are_kept_by_their_beginning(spark, raw_rows):
    root = work_folder(spark, "oversize")
    raw = raw_rows([("alpha", "{" + "z" * 70_000, 0, 7), ("beta", beta("A"), 1, 8)])
    Ingest(root).process(raw, 0, "run")
    kept = spark.read.parquet(f"{root}/oversize").collect()
    assert [(r.source_name, r.seq, r.payload) for r in kept] == [("alpha", 7, "{" + "z" * 1023)]
    assert Ingest(root).outcomes(spark).first()["oversize"] == 1


def test_the_ledger_is_dropped_behind_the_window_by_default(spark, raw_rows):
    root = work_folder(spark, "expiry")
    job = Ingest(root)
    for n, hour in enumerate((0, 10, 40)):
        job.process(raw_rows([("beta", beta(f"H{hour}"), hour * 3600)]), n, "run")
    assert sorted(r.batch_no for r in job.ledger(spark).collect()) == [2]


def test_loads_cost_no_more_jobs_the_more_is_stored(spark, raw_rows):
    """Forty loads into one table: as many jobs for the last as for the third, and one row per tick."""
    root = work_folder(spark, "many")
    job, jobs = Ingest(root, options=Options(dedup_window_ms=10_000)), []
    context = spark.sparkContext
    for n in range(12):
        context.setJobGroup(f"{root}-{n}", "load")
        job.process(raw_rows([("beta", beta(f"S{n}-{i}", n=n), 20 * n + i, 10 * n + i) for i in range(5)]), n, "run")
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"{root}-{n}")))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[-1] <= jobs[2] + 2
    assert load.read_table(spark, f"{root}/ticks").count() == 60


STEPS = ["nothing", "merged rows", "journal", "rename", "one deletion"]


@pytest.mark.parametrize("step", STEPS)
def test_a_compaction_that_stops_leaves_every_row_once(spark, tmp_path, monkeypatch, step):
    """Stopped after each of its steps; read as it is, then completed or undone."""
    rows = [(f"{n:04d}", f"S{n % 5}", T0 + timedelta(days=n % 2, seconds=n), ("beta", "gamma")[n % 3 == 0], n % 4) for n in range(60)]
    ticks = spark.createDataFrame(rows, "id string, symbol string, event_time timestamp, source string, n int").select(
        "id", "symbol", F.lit(1).cast("decimal(38,18)").alias("price"), F.lit(1).cast("decimal(38,18)").alias("volume"), "event_time",
        F.col("event_time").alias("received_at"), F.lit(1).cast("long").alias("seq"), "source", "n",
    )
    path = str(tmp_path / "ticks")
    for n in range(4):
        load.append_ticks(ticks.filter(F.col("n") == n).drop("n"), path, f"load-{n}")

    class Stop(Exception):
        pass

    left = {"merged rows": ("write", 0), "journal": ("rename", 1), "rename": ("delete", 0), "one deletion": ("delete", 1)}.get(step)
    if left:
        name, allowed = left
        plain = getattr(compaction._Files, name)
        calls = []

        def broken(self, *args):
            if "load_id" in str(args) or name != "delete":
                calls.append(args)
                if len(calls) > allowed:
                    raise Stop
            return plain(self, *args)

        monkeypatch.setattr(compaction._Files, name, broken)
        with pytest.raises(Stop):
            load.compact_table(spark, path, (T0 + timedelta(days=1)).date())
        monkeypatch.undo()

    def ids():
        return sorted(r.id for r in load.read_table(spark, path).select("id").collect())

    assert ids() == [r[0] for r in rows]
    # a load that comes meanwhile knows what is stored
    again = load.append_ticks(ticks.filter(F.col("n") == 0).drop("n"), path, "again")
    assert again == {"attempted": 15, "written": 0, "conflicts": 15}
    compaction.finish(spark, path)
    assert ids() == [r[0] for r in rows]
    merged = load.compact_table(spark, path, (T0 + timedelta(days=1)).date())
    assert merged == (1 if step in ("rename", "one deletion") else 2)
    assert ids() == [r[0] for r in rows]
    folders = load.read_table(spark, path).groupBy("event_date", "source").agg(F.count_distinct("load_id").alias("n")).collect()
    assert {(r.event_date.day - T0.day, r.n > 1) for r in folders} == {(0, False), (1, True)}
    assert not load.path_exists(spark, f"{path}/_compacted")
    assert load.compact_table(spark, path, T0.date()) == 0


def test_missing_ranges_inside_and_between_blocks(spark, raw_rows):
    numbers = [5, 6, 6, 9, 65_535, 65_536, 65_540, 400_000, 5 + 65_536 * 65_536 * 2, -3]
    rows = [("Alpha ", "{x", i, n) for i, n in enumerate(numbers)] + [("beta", "{x", 0, 7)]
    random.Random(1).shuffle(rows)
    got = sequence.missing_ranges(raw_rows(rows).repartition(4)).collect()
    ordered = sorted(set(numbers))
    expected = {("alpha", a + 1, b - 1, b - a - 1) for a, b in zip(ordered, ordered[1:], strict=False) if b - a > 1}
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    assert sequence.missing_ranges(raw_rows(rows).limit(0)).count() == 0


def test_sketches_merge_to_the_union(spark):
    rows = [(f"id{n}", "beta", T0 + timedelta(seconds=n)) for n in range(20_000)] + [(f"id{n}", "beta", T0 + timedelta(hours=20)) for n in range(9000)]
    sketches = dedup.key_sketches(spark.createDataFrame(rows, "id string, source string, received_at timestamp"), 600_000)
    found = dedup.estimated_keys(sketches, "source").first()
    assert abs(found["keys"] - 20_000) <= 4 * dedup.SKETCH_ERROR * 20_000
    assert sketches.agg(F.max(F.length("sketch"))).first()[0] < 5000


def test_files_of_a_merged_folder_hold_few_symbols(spark, tmp_path):
    """Of the files of one folder, those that can hold a symbol by their statistics are few; a frequent one is cut by time."""
    names = [f"S{n:02d}" for n in range(40)] + ["S07"] * 40
    rows = [(f"{n:05d}", names[n % 80], T0 + timedelta(seconds=n), n % 2) for n in range(4000)]
    ticks = spark.createDataFrame(rows, "id string, symbol string, event_time timestamp, n int").select(
        "id", "symbol", F.lit(1).cast("decimal(38,18)").alias("price"), F.lit(1).cast("decimal(38,18)").alias("volume"), "event_time",
        F.col("event_time").alias("received_at"), F.lit(1).cast("long").alias("seq"), F.lit("beta").alias("source"), "n",
    )
    path = str(tmp_path / "ticks")
    for n in range(2):
        load.append_ticks(ticks.filter(F.col("n") == n).drop("n"), path, f"load-{n}")
    assert load.compact_table(spark, path, (T0 + timedelta(days=1)).date(), 200) == 1
    spans = []
    for file in (tmp_path / "ticks").rglob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        column = meta.schema.names.index("symbol")
        stats = [meta.row_group(i).column(column).statistics for i in range(meta.num_row_groups)]
        spans.append((min(s.min for s in stats), max(s.max for s in stats)))
    assert len(spans) >= 15
    assert sum(low <= "S20" <= high for low, high in spans) <= 2
    assert sum(low == high == "S07" for low, high in spans) >= 5
    found = access.instrument_history(load.read_table(spark, path), "beta", "S20")
    assert found.count() == 50 and [r.id for r in found.collect()] == sorted((r[0] for r in rows if r[1] == "S20"), reverse=True)
