import pytest

import __spark_entry__ as entry
from compare import check, connect

SF = "/root/testdata/sf0.001"


def test_every_query_has_a_twin():
    assert set(entry.QUERIES) == set(entry.ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [
    "decimal_text", "decimal_canonical", "json_strictness", "dedup_window", "dead_letter_batches", "outcomes_by_source",
    "flap_streaks", "source_health", "replay_slice",
])
def test_small_scale_agrees(spark, name):
    con = connect(SF)
    assert check(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF) is None
