from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import T0
from quotemill import session
from quotemill.config import Options
from quotemill.operators import activity, load, normalize
from quotemill.plans import flow
from quotemill.schemas import RAW
from quotemill.session import work_folder
from quotemill.sources import feeds
from quotemill.streaming import metrics
from quotemill.streaming.ingest import Ingest, fast_dedup
from quotemill.streaming.writer import BatchWriter


def beta(symbol, price="1.5", n=0):
    return '{"s":"%s","p":%s,"q":"1","ts":%d}' % (symbol, price, 1780315200000 + n)


@pytest.fixture
def arrivals(raw_rows):
    """Three symbols, copies inside, at and after the window, one bad message, over 40 seconds."""
    rows = []
    for second in range(40):
        rows.append(("beta", beta(f"S{second % 3}", n=second % 3), second, second))
        if second % 10 == 4:
            rows.append(("beta", "{oops", second, 1000 + second))
        if second == 7:
            rows.append(("beta", beta("Y" * 40), second, 2000))
    return raw_rows(rows)


OPTIONS = Options(dedup_window_ms=10_000, batch_size=5)


def table(spark, root):
    return sorted(load.read_table(spark, f"{root}/ticks").select("id", "symbol", "received_at").collect())


def part(raw, low, high):
    seconds = F.unix_micros("received_at") / 1_000_000 - T0.timestamp()
    return raw.filter((seconds >= low) & (seconds < high))


def test_micro_batches_equal_one_batch(spark, arrivals):
    one, many = work_folder(spark, "one"), work_folder(spark, "many")
    whole, parts = Ingest(one, options=OPTIONS), Ingest(many, options=OPTIONS)
    whole.process(arrivals, 0, "run")
    for n in range(5):
        parts.process(part(arrivals, n * 8, n * 8 + 8), n, "run")
    names = ["raw", "invalid", "accepted", "duplicate", "written", "conflicts", "dead_lettered", "dropped"]

    def totals(job):
        return job.outcomes(spark).agg(*[F.sum(n).alias(n) for n in names]).first()

    a, b = totals(whole), totals(parts)
    assert a == b and table(spark, one) == table(spark, many)
    assert a["raw"] == a["accepted"] + a["duplicate"] + a["invalid"]
    assert a["accepted"] == a["written"] + a["conflicts"] + a["dead_lettered"] + a["dropped"]
    run = flow.run(arrivals, OPTIONS)
    batch = flow.outcomes(run, flow.empty_table(spark)).groupBy("outcome").count()
    got = {r["outcome"]: r["count"] for r in batch.collect()}
    assert (got["written"], got["conflict"], got["dead_lettered"]) == (a["written"], a["conflicts"], a["dead_lettered"])
    anchors = whole.ledger(spark).groupBy("id").count().orderBy("count").collect()
    assert [r["count"] for r in anchors] == [1, 4, 4, 4]


def test_a_replayed_batch_changes_nothing(spark, arrivals):
    root = work_folder(spark, "replay")
    job = Ingest(root, options=OPTIONS)
    for n in range(2):
        job.process(part(arrivals, n * 20, n * 20 + 20), n, "run")
    before, counts = table(spark, root), sorted(job.outcomes(spark).collect())
    ledger = sorted(job.ledger(spark).collect())
    job.process(part(arrivals, 20, 40), 1, "run")
    job.process(part(arrivals, 0, 20), 0, "run")
    assert table(spark, root) == before and sorted(job.outcomes(spark).collect()) == counts
    assert sorted(job.ledger(spark).collect()) == ledger


def test_a_batch_that_broke_off_is_completed(spark, arrivals):
    root = work_folder(spark, "broken")
    stops = [RuntimeError("driver lost")]

    def store(ticks, load_id):
        counts = load.append_ticks(ticks, f"{root}/ticks", load_id)
        if stops:
            raise KeyboardInterrupt from stops.pop()
        return counts

    writer = BatchWriter(f"{root}/ticks", f"{root}/dead_letter", OPTIONS, store=store)
    job = Ingest(root, options=OPTIONS, writer=writer)
    with pytest.raises(KeyboardInterrupt):
        job.process(arrivals, 0, "run")
    job.process(arrivals, 0, "run")
    row = job.outcomes(spark).first()
    assert row["written"] == len(table(spark, root)) and row["written"] == 3


def test_query_restarts_from_its_checkpoint(spark, arrivals):
    root, landing = work_folder(spark, "restart"), work_folder(spark, "landing")
    job = Ingest(root, options=OPTIONS)
    for n in range(2):
        part(arrivals, n * 20, n * 20 + 20).coalesce(1).write.mode("append").parquet(landing)
        job.start(feeds.stream_messages(spark, landing), f"{root}/checkpoint").awaitTermination()
    job.start(feeds.stream_messages(spark, landing), f"{root}/checkpoint").awaitTermination()
    assert job.outcomes(spark).count() == 2
    whole = work_folder(spark, "whole")
    Ingest(whole, options=OPTIONS).process(arrivals, 0, "run")
    assert table(spark, root) == table(spark, whole)


def test_a_batch_leaves_no_scratch_folders(spark, arrivals, monkeypatch):
    made = []
    plain = session.work_folder
    monkeypatch.setattr(session, "work_folder", lambda s, label: made.append(plain(s, label)) or made[-1])
    Ingest(plain(spark, "tidy"), options=OPTIONS).process(part(arrivals, 0, 5), 0, "run")
    assert made and not any(load.path_exists(spark, path) for path in made)


def test_ledger_hours_can_be_dropped(spark, arrivals):
    root = work_folder(spark, "expire")
    job = Ingest(root, options=OPTIONS)
    job.process(arrivals, 0, "run")
    assert job.expire_ledger(spark, T0 + timedelta(minutes=59)) == 0
    assert job.expire_ledger(spark, T0 + timedelta(minutes=60)) == 1
    assert job.ledger(spark).count() == 0


def test_text_landing_folders(spark, sources):
    root = work_folder(spark, "text")
    for name, lines in (("alpha", ["{bad"]), ("beta", [beta("A"), beta("B")])):
        spark.createDataFrame([(x,) for x in lines], "value string").write.text(f"{root}/source_name={name}")
    rows = normalize.parse(feeds.read_text(spark, root), sources)
    assert sorted((r["source"], r["status"]) for r in rows.collect()) == [
        ("alpha", "invalid"), ("beta", "valid"), ("beta", "valid")
    ]
    streams = [feeds.stream_text(spark, f"{root}/source_name={s}", s) for s in ("alpha", "beta")]
    out = work_folder(spark, "out")
    job = Ingest(out, options=OPTIONS)
    job.start(feeds.union_of(streams), f"{out}/checkpoint").awaitTermination()
    row = job.outcomes(spark).agg(F.sum("raw"), F.sum("invalid"), F.sum("written")).first()
    assert tuple(row) == (3, 1, 2)


def test_kafka_records(spark):
    records = spark.createDataFrame(
        [(bytearray(b"{}"), "beta", T0 + timedelta(seconds=1), n, 7) for n in (0, 1)],
        "value binary, topic string, timestamp timestamp, partition int, offset bigint",
    )
    raw = feeds.from_kafka(records)
    assert raw.schema.simpleString() == spark.createDataFrame([], RAW).schema.simpleString()
    assert sorted(r.seq for r in raw.collect()) == [7, (1 << 48) + 7] and raw.first()["payload"] == "{}"


def test_fast_option_suppresses_longer(spark):
    """Arrivals at 0, 5, 9, 10, 15, 21, 22, 30 s, one per run: the rule keeps 0, 10 and 21."""
    landing, out = work_folder(spark, "fast"), work_folder(spark, "fast-out")
    for n, second in enumerate([0, 5, 9, 10, 15, 21, 22, 30]):
        row = spark.createDataFrame([("x", T0 + timedelta(seconds=second))], "id string, received_at timestamp")
        row.coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(row.schema).parquet(landing)
        fast_dedup(stream, 10_000).writeStream.option("checkpointLocation", f"{out}/cp").trigger(
            availableNow=True
        ).format("parquet").start(f"{out}/rows").awaitTermination()
    kept = [r[0].second for r in spark.read.parquet(f"{out}/rows").select("received_at").orderBy("received_at").collect()]
    assert kept[0] == 0 and len(kept) < 3


def test_metrics_count_late_rows_and_keep_open_sessions(spark, raw_rows, sources):
    """Micro-batches out of order: hours late, into an old session, between two of them, and a source that still sends."""
    batches = [
        [("alpha", "{oops", 0), ("alpha", "{oops", 8), ("beta", beta("A"), 1)],
        [("beta", beta("A"), 7200), ("alpha", "{oops", 7201), ("alpha", "{oops", 7204)],
        [("alpha", "{oops", 4), ("beta", beta("A"), 3), ("alpha", "{oops", 3000)],
    ]
    root, landing = work_folder(spark, "late"), work_folder(spark, "landing")
    for rows in batches:
        raw_rows(rows).coalesce(1).write.mode("append").parquet(landing)
        stream = feeds.stream_messages(spark, landing)
        cells = metrics.run_in_parts(
            stream, lambda rows: activity.arrivals(rows, sources), f"{root}/cells", f"{root}/checkpoint-0"
        )
        parsed = normalize.parse(stream, sources)
        counts = metrics.run_in_parts(parsed, metrics.heartbeat_part, f"{root}/counts", f"{root}/checkpoint-1")
    start = int(T0.timestamp())
    found = {(r.source, r.first_at // 10**6 - start, r.last_at // 10**6 - start, r.messages, r.ended)
             for r in metrics.session_activity(cells).collect()}
    assert found == {("alpha", 0, 8, 3, True), ("alpha", 3000, 3000, 1, True), ("alpha", 7201, 7204, 2, False),
                     ("beta", 1, 3, 2, True), ("beta", 7200, 7200, 1, False)}
    beats = {(r.at // 10**6 - start, r.raw, r.invalid, r.valid) for r in metrics.heartbeat_counts(counts).collect()}
    assert beats == {(10, 5, 3, 2), (3010, 1, 1, 0), (7210, 3, 2, 1)}


def test_a_second_checkpoint_keeps_what_the_first_stored(spark, arrivals):
    root = work_folder(spark, "runs")
    for n in range(2):
        landing = work_folder(spark, "landing")
        part(arrivals, n * 20, n * 20 + 20).coalesce(1).write.parquet(landing)
        Ingest(root, options=OPTIONS).start(feeds.stream_messages(spark, landing), f"{root}/checkpoint-{n}").awaitTermination()
    whole = work_folder(spark, "whole")
    Ingest(whole, options=OPTIONS).process(arrivals, 0, "run")
    assert table(spark, root) == table(spark, whole)
    assert Ingest(root, options=OPTIONS).outcomes(spark).count() == 2


def test_a_batch_job_names_its_run(spark, arrivals):
    with pytest.raises(ValueError):
        Ingest(work_folder(spark, "unnamed"), options=OPTIONS).process(arrivals, 0)
