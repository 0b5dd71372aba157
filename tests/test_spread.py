"""How the rows of the test tables are dealt to tasks, and how often they are read."""

from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import T0
from quotemill import session
from quotemill.operators import dedup, load
from quotemill.plans import flow, queries
from quotemill.session import work_folder
from quotemill.sources import tables

ROWS = 40_000


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rows_of_few_row_groups_are_shared_by_all_tasks(spark, tmp_path, small_splits, monkeypatch):
    events = pa.table({
        "event_id": pa.array(range(ROWS), pa.int64()), "ts": pa.array([datetime(2026, 6, 1)] * ROWS, pa.timestamp("us")),
        "user_id": pa.array(range(ROWS), pa.int64()), "event_type": ["click"] * ROWS, "value": [1.5] * ROWS,
        "props": ['{"k": 5}'] * ROWS,
    })
    pq.write_table(events, tmp_path / "events.parquet", row_group_size=ROWS // 2, compression="none", use_dictionary=False)

    def most():
        counts = tables.read_events(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in counts) == ROWS
        return max(r["count"] for r in counts)

    assert most() <= 1.5 * ROWS / spark.sparkContext.defaultParallelism
    monkeypatch.setattr(tables, "TASK_EVENTS", 1000)
    assert most() <= 1500


def test_more_events_make_more_tasks_not_longer_ones(spark, tmp_path):
    rows = 100_000 * spark.sparkContext.defaultParallelism
    events = pa.table({
        "event_id": pa.array(range(rows), pa.int64()), "ts": pa.array([datetime(2026, 6, 1)] * rows, pa.timestamp("us")),
        "user_id": pa.array(range(rows), pa.int64()), "event_type": ["click"] * rows, "value": [1.5] * rows,
        "props": ['{"k": 5}'] * rows,
    })
    pq.write_table(events, tmp_path / "events.parquet", row_group_size=rows // 2)
    counts = tables.read_events(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in counts) == rows
    assert max(r["count"] for r in counts) <= 30_000


def test_landing_in_parts_makes_each_message_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    raw = spark.range(1000).select(F.timestamp_micros(F.col("id") * 1000).alias("received_at"), F.col("id").alias("seq"))
    landing, held = work_folder(spark, "landing"), []
    queries._in_parts(
        spark, raw.mapInArrow(count, raw.schema), landing, lambda: held.append(spark.read.parquet(landing).count()), delayed=500
    )
    assert held == [249, 500, 749, 1000]  # 0 and 500 come one part later
    assert made.value == 2000  # once for the first and last arrival, once for all parts


def test_few_failed_batches_are_joined_without_a_shuffle_of_the_ticks(spark):
    checked = spark.range(200_000).select(
        F.lit("alpha").alias("source"), F.expr("id div 500").alias("batch_no"), F.col("id").alias("seq"),
        F.lit(T0).alias("received_at"), F.when(F.col("id") % 100_000 == 7, "bad").alias("violation"),
    )
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        routed = load.route(checked)
        assert "BroadcastHashJoin" in routed._jdf.queryExecution().executedPlan().toString()
        assert routed.filter("failure = 'bad'").count() == 1000 and routed.count() == 200_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def _write_events(folder, props, ids=None):
    rows = len(props)
    events = pa.table({
        "event_id": pa.array(ids or range(1, rows + 1), pa.int64()),
        "ts": pa.array([datetime(2026, 6, 1, 0, n // 60, n % 60) for n in range(rows)], pa.timestamp("us")),
        "user_id": pa.array(range(rows), pa.int64()), "event_type": ["click"] * rows, "value": [1.5] * rows, "props": props,
    })
    pq.write_table(events, folder / "events.parquet")


def test_properties_read_as_by_the_json_reader(spark):
    odd = ['{"k": 5}', '{"k": 0}', '{"k": -5}', '{"k": -0}', '{"k": +5}', '{"k": 007}', '{"k": 5 }', '{"k":  5}', '{"k":5}', '{"k": 5.0}',
           '{"k": 5e1}', '{"k": "5"}', '{"k": null}', '{"k": }', '{"k": 5}}', '{"k": 5}x', '{"k": 5, "a": 1}', '{"a": 1, "k": 5}',
           '{"k": 1}{"k": 2}', '{"k": 9223372036854775807}', '{"k": 9223372036854775808}', '{"k": ５}', '{"k": true}', "{}", "", "x", None]
    frame = spark.createDataFrame([(text,) for text in odd], "props string")
    rows = frame.select("props", tables._k(F.col("props")).alias("k"), F.from_json("props", "k bigint").k.alias("by_reader")).collect()
    assert [(r.props, r.k) for r in rows] == [(r.props, r.by_reader) for r in rows]
    assert rows[0].k == 5 and rows[2].k == -5


def test_a_load_neither_routes_nor_copies_what_was_accepted(spark, tmp_path, monkeypatch):
    _write_events(tmp_path, [f'{{"k": {n % 100}}}' for n in range(300)])
    written, plain = [], session.materialize

    def stored(df, label):
        written.append(label)
        return plain(df, label)

    for module in (queries, flow, load, dedup):
        monkeypatch.setattr(module, "materialize", stored)
    path = queries._stored(spark, str(tmp_path))
    assert load.read_table(spark, path).count() > 250
    assert set(written) == {"parsed", "dedup-spans", "dedup-long", "dedup-folded"}


def test_routing_runs_when_asked_for(spark, tmp_path):
    _write_events(tmp_path, [f'{{"k": {n % 100}}}' for n in range(600)], range(400, 1000))
    run = queries._flow(spark, str(tmp_path), extended=True)
    assert run.routed is run.routed
    assert run.routed.count() == run.accepted.count()
    assert run.routed.filter("failure is not null").count() > 0
