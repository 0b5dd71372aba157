import sys
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from quotemill.session import local_session  # noqa: E402

T0 = datetime(2026, 6, 1, 12, 0, 0, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "8", "4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sources(spark):
    from quotemill.config import DEFAULT_SOURCES
    from quotemill.sources.registry import registry

    return registry(spark, DEFAULT_SOURCES)


@pytest.fixture
def raw_rows(spark):
    """(source, payload[, seconds after T0[, seq[, message type]]]) tuples as raw messages."""
    from quotemill.schemas import RAW

    def build(rows):
        out = []
        for i, row in enumerate(rows):
            source, payload, *rest = row
            second = rest[0] if rest else i
            seq = rest[1] if len(rest) > 1 else i
            kind = rest[2] if len(rest) > 2 else "text"
            out.append((source, payload, kind, T0 + timedelta(seconds=second), seq))
        return spark.createDataFrame(out, RAW)

    return build
