"""Writing one batch with retries and a dead letter."""

from __future__ import annotations

import logging
import time
from collections import Counter
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F

from ..config import Options
from ..operators import load
from ..operators.deadletter import append_dead_letters, dead_letters

log = logging.getLogger(__name__)

COUNTED = ("written", "conflicts", "dead_lettered", "dropped", "attempt_failures")
STOPS = (KeyboardInterrupt, SystemExit)

# Java failures that may pass when tried again
TRANSIENT_JAVA = (
    "java.io.IOException",
    "java.net.SocketException",
    "java.net.SocketTimeoutException",
    "java.util.concurrent.TimeoutException",
    "java.sql.SQLTransientException",
    "java.sql.SQLRecoverableException",
)


def is_transient(error: BaseException) -> bool:
    """True if the error or one of its causes is a timeout or an I/O failure."""
    seen: set[int] = set()
    current: BaseException | None = error
    while current is not None and id(current) not in seen:
        seen.add(id(current))
        if isinstance(current, (TimeoutError, OSError)):
            return True
        if isinstance(current, PySparkException) or hasattr(current, "java_exception"):
            if any(name in str(current) for name in TRANSIENT_JAVA):
                return True
        current = current.__cause__ or current.__context__
    return False


def retry_delay_ms(retry: int, options: Options) -> int:
    """Doubles from the initial delay, up to the maximum."""
    return min(options.retry_initial_ms * 2 ** max(retry - 1, 0), options.retry_max_ms)


class BatchWriter:
    """Loads accepted ticks into the stored table; what cannot be loaded goes to the dead letter.

    ``store`` and ``bury`` are replaceable, so other tables can be written and failures can be injected in tests.
    """

    def __init__(
        self,
        table_path: str,
        dead_letter_path: str,
        options: Options = Options(),
        scope: str = "batch",
        store: Callable[[DataFrame, str], dict[str, int]] | None = None,
        bury: Callable[[DataFrame, str, datetime], None] | None = None,
        transient: Callable[[BaseException], bool] = is_transient,
        sleep: Callable[[float], None] = time.sleep,
    ):
        self.options = options
        self.scope = scope
        self.store = store or (lambda ticks, load_id: load.append_ticks(ticks, table_path, load_id))
        self.bury = bury or (
            lambda records, load_id, failed_at: append_dead_letters(records, dead_letter_path, load_id, failed_at)
        )
        self.transient = transient
        self.sleep = sleep

    def write(self, accepted: DataFrame, load_id: str) -> dict[str, int]:
        """Write one batch and return its outcome counts. ``accepted`` is read several times: pass a stored frame."""
        counts = Counter(dict.fromkeys(COUNTED, 0))
        live = self._set_aside(accepted, load_id, counts)
        delays = [retry_delay_ms(n, self.options) / 1000 for n in range(1, self.options.max_retries + 1)]
        problem: BaseException | None = None
        try:
            for delay in [*delays, None]:
                problem = self._attempt(live, load_id, counts)
                if problem is None or delay is None or not self.transient(problem):
                    break
                self.sleep(delay)
        except STOPS as stop:
            problem = problem or stop
            raise
        finally:
            # reached with a problem after the last attempt and on a stop: either way these ticks need an outcome
            if problem is not None:
                self._bury(live, live.count(), load_id, F.lit(type(problem).__name__), F.lit(str(problem)), counts)
        return dict(counts)

    def _set_aside(self, accepted: DataFrame, load_id: str, counts: Counter) -> DataFrame:
        """Bury the batches that break a constraint; what is left can be stored."""
        checked = load.check_constraints(load.assign_batches(accepted, self.options.batch_size))
        routed = load.route(checked, self.scope)
        failed = routed.filter(F.col("failure").isNotNull())
        batches, rows = failed.agg(F.count_distinct("source", "batch_no"), F.count(F.lit(1))).first()
        if not rows:
            return accepted
        counts["attempt_failures"] += batches
        self._bury(failed, rows, f"{load_id}-constraint", F.lit(load.VIOLATION), F.col("failure"), counts)
        return routed.filter(F.col("failure").isNull()).select(*accepted.columns)

    def _attempt(self, ticks: DataFrame, load_id: str, counts: Counter) -> Exception | None:
        """Store once: the counts grow, or the reason why not is returned."""
        try:
            result = self.store(ticks, load_id)
        except Exception as problem:
            counts["attempt_failures"] += 1
            return problem
        counts.update(written=result["written"], conflicts=result["conflicts"])
        return None

    def _bury(self, ticks: DataFrame, rows: int, load_id: str, kind, message, counts: Counter) -> None:
        failed_at = datetime.now(timezone.utc)
        try:
            self.bury(dead_letters(ticks, kind, message, failed_at), load_id, failed_at)
            counts["dead_lettered"] += rows
        except Exception as problem:
            counts["dropped"] += rows
            log.critical("load %s: %d ticks lost, the dead letter failed too: %s", load_id, rows, problem)
