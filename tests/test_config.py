import pytest

from quotemill.config import Options, Source
from quotemill.operators.formats import FORMATS
from quotemill.sources.registry import check_formats, check_registry, registry


def test_defaults_and_a_fourth_source_are_valid():
    Options().check()
    Options(sources=(*Options().sources, Source("delta", "alpha-v1"))).check()


@pytest.mark.parametrize("changes", [
    {"sources": ()},
    {"sources": (Source("alpha", "alpha-v1"), Source("ALPHA", "alpha-v1"))},
    {"sources": (Source(" ", "alpha-v1"),)},
    {"sources": (Source("alpha", " "),)},
    {"sources": (Source("alpha", "alpha-v1", 0),)},
    {"batch_size": 0},
    {"dedup_window_ms": 0},
    {"max_retries": -1},
    {"retry_initial_ms": 10, "retry_max_ms": 5},
])
def test_bad_options_are_refused(changes):
    with pytest.raises(ValueError):
        Options(**changes).check()


def test_registry_table_is_checked_before_the_join(spark):
    check_registry(registry(spark, [Source("a", "ALPHA-V1")]), FORMATS)
    with pytest.raises(ValueError, match="duplicate"):
        check_registry(registry(spark, [Source("a", "alpha-v1"), Source("A", "alpha-v1")]), FORMATS)
    with pytest.raises(ValueError, match="no reader"):
        check_registry(registry(spark, [Source("a", "omega-v1")]), FORMATS)
    with pytest.raises(ValueError, match="no reader"):
        check_formats([Source("a", "omega-v1")], FORMATS)
