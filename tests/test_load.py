from datetime import date, datetime, timedelta, timezone
from decimal import Decimal

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import T0
from quotemill.config import Options
from quotemill.operators import load
from quotemill.operators.deadletter import append_dead_letters, dead_letters, read_dead_letters
from quotemill.session import materialize, work_folder
from quotemill.streaming.writer import BatchWriter, is_transient, retry_delay_ms
from test_dedup import SCHEMA


@pytest.fixture
def tick(spark):
    def build(*rows):
        out = []
        for n, row in enumerate(rows):
            full = {"id": f"id{n}", "symbol": "EURUSD", "price": "1.085", "volume": "1", "at": n, "seq": n, **row}
            when = T0 + timedelta(milliseconds=full["at"])
            out.append((full["id"], full["symbol"], Decimal(full["price"]), Decimal(full["volume"]), when, 1, "alpha",
                        when + timedelta(seconds=1), full["seq"]))
        return spark.createDataFrame(out, SCHEMA)

    return build


def test_constraints(tick):
    rows = tick(
        {}, {"symbol": "X" * 33}, {"price": "0.00000000004"}, {"price": "0.00000000005"},
        {"volume": "1234567890123456789"}, {"symbol": "X" * 32}, {"volume": "123456789012345678.99999999999"},
    )
    got = [r["violation"] for r in load.check_constraints(rows).orderBy("seq").collect()]
    assert got == [
        None, load.TOO_LONG.format(32), load.CHECK_FAILED.format("price"), None, load.OVERFLOW, None, None
    ]


def test_one_bad_row_fails_its_batch(tick):
    rows = tick({"seq": 1}, {"seq": 2, "symbol": "X" * 40}, {"seq": 499}, {"seq": 500}, {"seq": 501})
    checked = load.check_constraints(load.assign_batches(rows, 500))
    whole = {r["seq"]: r["failure"] for r in load.route(checked).collect()}
    only = {r["seq"]: r["failure"] for r in load.route(checked, "row").collect()}
    text = load.TOO_LONG.format(32)
    assert whole == {1: text, 2: text, 499: text, 500: None, 501: None}
    assert only == {1: None, 2: text, 499: None, 500: None, 501: None}


def test_loading_is_idempotent(spark, tick):
    path = work_folder(spark, "ticks")
    rows = tick({}, {}, {"id": "id0", "at": 90_000})
    assert load.append_ticks(rows, path, "a") == {"attempted": 3, "written": 2, "conflicts": 1}
    before = sorted(load.read_table(spark, path).drop("persisted_at").collect())
    assert load.append_ticks(rows, path, "a") == {"attempted": 3, "written": 2, "conflicts": 1}
    assert load.append_ticks(rows, path, "b") == {"attempted": 3, "written": 0, "conflicts": 3}
    assert sorted(load.read_table(spark, path).drop("persisted_at").collect()) == before
    more = tick({}, {"id": "new"})
    assert load.append_ticks(more, path, "c") == {"attempted": 2, "written": 1, "conflicts": 1}
    stored = load.read_table(spark, path)
    assert stored.count() == 3 and stored.first()["price"] == Decimal("1.0850000000")


def test_long_folder_lists_give_the_same(spark, tick, monkeypatch):
    monkeypatch.setattr(load, "FOLDER_LIMIT", 0)
    path = work_folder(spark, "ticks")
    load.append_ticks(tick({}, {"at": 200_000_000}), path, "a")
    assert load.append_ticks(tick({}, {"at": 200_000_000}, {"id": "new"}), path, "b")["written"] == 1


def test_reads_prune_folders(spark, tick):
    path = work_folder(spark, "ticks")
    load.append_ticks(tick({}, {"at": 200_000_000}), path, "a")
    from quotemill.operators.access import instrument_history

    day = datetime(2026, 6, 3, tzinfo=timezone.utc)
    found = instrument_history(load.read_table(spark, path), "Alpha", "eurusd", start=day)
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source" in plan and "event_date" in plan.split("PartitionFilters")[1]
    assert "PushedFilters: [IsNotNull(symbol)" in plan


def test_dead_letters_are_json_lines(spark, tick):
    path, now = work_folder(spark, "dead"), datetime(2026, 6, 2, 23, 59, tzinfo=timezone.utc)
    records = dead_letters(tick({"at": 1}), F.lit("TimeoutError"), F.lit("too late"), now)
    append_dead_letters(records, path, "b1", now)
    append_dead_letters(records, path, "b1", now)
    append_dead_letters(records.limit(0), path, "b2", now)
    rows = read_dead_letters(spark, path).collect()
    assert len(rows) == 1
    assert rows[0]["failed_date"] == "20260602" and rows[0]["error_message"] == "too late"
    assert rows[0]["tick"]["price"] == Decimal("1.085") and rows[0]["tick"]["timestamp"].microsecond == 1000


class Store:
    def __init__(self, *results):
        self.results, self.calls = list(results), 0

    def __call__(self, ticks, load_id):
        self.calls += 1
        result = self.results.pop(0) if self.results else None
        if isinstance(result, BaseException):
            raise result
        return result or {"written": ticks.count(), "conflicts": 0}


def writer(store, buried=None, retries=2, bury=None, waits=None):
    buried = [] if buried is None else buried
    return BatchWriter(
        "unused", "unused", Options(max_retries=retries), store=store,
        bury=bury or (lambda records, load_id, at: buried.append((load_id, records.count()))),
        sleep=(waits if waits is not None else []).append,
    )


def test_transient_failure_is_retried_then_dead_lettered(tick):
    store, buried, waits = Store(*[TimeoutError("gone")] * 3), [], []
    counts = writer(store, buried, waits=waits).write(tick({}, {}), "b")
    assert store.calls == 3 and buried == [("b", 2)] and waits == [0.25, 0.5]
    assert counts == {"written": 0, "conflicts": 0, "dead_lettered": 2, "dropped": 0, "attempt_failures": 3}


def test_recovery_after_a_retry(tick):
    store, buried = Store(ConnectionError("reset")), []
    counts = writer(store, buried).write(tick({}, {}), "b")
    assert counts["written"] == 2 and counts["attempt_failures"] == 1 and not buried


def test_permanent_failure_is_not_retried(tick):
    store, buried = Store(ValueError("bad"), ValueError("bad")), []
    counts = writer(store, buried, retries=4).write(tick({}, {}), "b")
    assert store.calls == 1 and counts["dead_lettered"] == 2


def test_conflicts_are_counted_apart(tick):
    counts = writer(Store({"written": 1, "conflicts": 1})).write(tick({}, {}), "b")
    assert (counts["written"], counts["conflicts"], counts["attempt_failures"]) == (1, 1, 0)


def test_both_failing_is_counted_as_dropped(tick):
    def bury(*_):
        raise OSError("disk")

    counts = writer(Store(TimeoutError("gone")), retries=0, bury=bury).write(tick({}, {}, {}), "b")
    assert counts["dropped"] == 3 and counts["dead_lettered"] == 0


def test_a_forced_stop_dead_letters_before_it_goes_on(tick):
    buried = []
    with pytest.raises(KeyboardInterrupt):
        writer(Store(KeyboardInterrupt()), buried).write(tick({}, {}, {}), "b")
    assert buried == [("b", 3)]


def test_bad_rows_leave_before_the_store(tick):
    store, buried = Store(), []
    rows = tick({"seq": 1}, {"seq": 2, "symbol": "X" * 40}, {"seq": 700})
    counts = writer(store, buried).write(rows, "b")
    assert buried == [("b-constraint", 2)]
    assert (counts["written"], counts["dead_lettered"], counts["attempt_failures"]) == (1, 2, 1)


def test_error_classes_and_delays():
    wrapped = RuntimeError("load failed")
    wrapped.__cause__ = ConnectionResetError("reset")
    assert is_transient(wrapped) and is_transient(TimeoutError()) and not is_transient(ValueError("x"))
    assert [retry_delay_ms(n, Options()) for n in (1, 2, 3, 4, 5)] == [250, 500, 1000, 2000, 2000]


def test_numbers_are_rounded_once_for_all_constraints(spark, tick):
    plan = load.check_constraints(materialize(tick({}), "ticks"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("cast(price") == 1


def test_a_load_reads_the_ticks_for_their_folders_and_once_more(spark, tick):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = tick({}, {}, {"at": 90_000})
    path = work_folder(spark, "ticks")
    counts = load.append_ticks(rows.mapInArrow(count, rows.schema), path, "a")
    assert counts["attempted"] == 3 and made.value == 6


def test_stored_ids_have_no_dictionary(spark, tick, tmp_path):
    path = str(tmp_path / "ticks")
    load.append_ticks(tick({}, {"at": 90_000}), path, "a")
    load.append_ticks(tick({"id": "new"}), path, "b")
    load.compact_table(spark, path, date(9999, 1, 1))
    files = list((tmp_path / "ticks").rglob("*.parquet"))
    assert files
    for file in files:
        group = pq.ParquetFile(file).metadata.row_group(0)
        columns = {group.column(i).path_in_schema: group.column(i).encodings for i in range(group.num_columns)}
        assert not any("DICTIONARY" in e for e in columns["id"])
        assert any("DICTIONARY" in e for e in columns["symbol"])
