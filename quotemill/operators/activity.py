"""Feed activity: heartbeat series, idle gaps, sessions, flap streaks, reconnects, liveness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions.moments import floor_div
from ..functions.text import strip
from ..session import materialize
from ..sources.registry import with_source
from .segments import previous_value, running_total

DAY = 86_400_000_000  # microseconds
PART = 65_536  # sessions of a source that one task walks


def arrivals(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source and time cell: first and last arrival and message count.

    A cell is as long as the idle timeout of its source. Two arrivals of one cell are closer than the timeout, so
    a stall always lies between cells and the messages themselves need no ordering. Their number shrinks before the
    shuffle to at most one row per task, source and cell.
    """
    cells = with_source(raw, sources).filter(F.col("idle_timeout_ms").isNotNull()).select(
        F.lower(strip(F.col("source_name"))).alias("source"),
        (F.col("idle_timeout_ms") * 1000).alias("timeout"),
        F.unix_micros("received_at").alias("at"),
    )
    return (
        cells.groupBy("source", "timeout", floor_div(F.col("at"), F.col("timeout")).alias("cell"))
        .agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("messages"))
        .withColumn("day", floor_div(F.col("first_at"), DAY))
    )


def merge_arrivals(parts: DataFrame) -> DataFrame:
    """The ``arrivals`` of all messages from those of parts of them."""
    return (
        parts.groupBy("source", "timeout", "cell")
        .agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("messages").alias("messages"))
        .withColumn("day", floor_div(F.col("first_at"), DAY))
    )


def _with_previous(cells: DataFrame) -> DataFrame:
    return previous_value(cells, ["source"], "day", ["cell"], "last_at", "previous_at")


def idle_gaps(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """Stalls: no message of a source for at least its idle timeout. Any message counts, valid or not."""
    gap = F.col("first_at") - F.col("previous_at")
    return _with_previous(arrivals(raw, sources)).filter(gap >= F.col("timeout")).select(
        "source", F.col("previous_at").alias("stalled_after"), F.col("first_at").alias("resumed_at"), gap.alias("gap")
    )


def sessions(raw: DataFrame, sources: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Activity between stalls, numbered per source.

    ``duration`` runs from the first to the last message, plus the idle timeout if a stall ended the session. The
    last session of a source has ended if ``as_of`` (microseconds) is at least the timeout behind its last message.
    """
    return sessions_of(arrivals(raw, sources), as_of)


def sessions_of(cells: DataFrame, as_of: Column | None = None) -> DataFrame:
    """``sessions`` from the ``arrivals`` of the messages."""
    starts = F.col("previous_at").isNull() | (F.col("first_at") - F.col("previous_at") >= F.col("timeout"))
    cells = _with_previous(cells).withColumn("starts", starts.cast("int"))
    numbered = running_total(cells, ["source"], "day", ["cell"], {"session_no": "starts"})
    found = materialize(
        numbered.groupBy("source", "timeout", "session_no").agg(
            F.min("first_at").alias("first_at"),
            F.max("last_at").alias("last_at"),
            F.sum("messages").alias("messages"),
        ),
        "sessions",
    )
    # One row per source instead of a window over all its sessions.
    newest = found.groupBy("source").agg(F.max("session_no").alias("_newest"))
    lapsed = F.lit(False) if as_of is None else as_of - F.col("last_at") >= F.col("timeout")
    ended = (F.col("session_no") < F.col("_newest")) | lapsed
    return found.join(newest, "source").withColumn("ended", ended).drop("_newest").withColumn(
        "duration", F.col("last_at") - F.col("first_at") + F.when(F.col("ended"), F.col("timeout")).otherwise(0)
    )


def flap_streaks(ended_or_open: DataFrame, stability_ms: int = fv.STABILITY_MS,
                 cap: int = fv.STREAK_CAP) -> DataFrame:
    """Consecutive-failure count after each ended session; a stable session sets it back to 1.

    Sessions are numbered without gaps, so the count follows from the number that the streak began with. Streaks are
    told apart by a running total over parts of a source, as one that flaps has too many sessions for one task."""
    ended = ended_or_open.filter("ended").select(
        "source", "session_no", "duration", (F.col("duration") >= stability_ms * 1000).alias("stable")
    )
    parts = ended.withColumn("_stable", F.col("stable").cast("int")).withColumn("_part", F.expr(f"session_no div {PART}"))
    streaks = materialize(running_total(parts, ["source"], "_part", ["session_no"], {"_island": "_stable"}), "streaks")
    began = streaks.groupBy("source", "_island").agg(F.min("session_no").alias("_began"))
    position = (F.col("session_no") - F.col("_began") + 1).cast("int")
    return streaks.join(began, ["source", "_island"]).select(
        "source", "session_no", "duration", "stable", F.least(position, F.lit(cap)).alias("streak")
    )


def reconnects(found: DataFrame) -> DataFrame:
    """Reconnects per source: every session after the first."""
    return found.groupBy("source").agg((F.count(F.lit(1)) - 1).alias("reconnects"))


def last_seen(raw: DataFrame) -> DataFrame:
    """Last arrival per source, in microseconds."""
    return raw.groupBy(F.lower(strip(F.col("source_name"))).alias("source")).agg(
        F.max(F.unix_micros("received_at")).alias("last_at")
    )


def liveness(raw: DataFrame, sources: DataFrame, as_of: Column) -> DataFrame:
    """Every configured source with ``connected`` as of a moment (microseconds); a source never seen is down."""
    seen = last_seen(raw.filter(F.unix_micros("received_at") <= as_of))
    configured = sources.select(F.lower("name").alias("source"), (F.col("idle_timeout_ms") * 1000).alias("timeout"))
    return configured.join(seen, "source", "left").select(
        "source", "last_at", F.coalesce(as_of - F.col("last_at") < F.col("timeout"), F.lit(False)).alias("connected")
    )


def state_changes(found: DataFrame) -> DataFrame:
    """Connection states over time: up at the first message of a session, down when it stalls."""
    up = found.select("source", F.col("first_at").alias("at"), F.col("session_no"), F.lit(True).alias("connected"))
    down = found.filter("ended").select(
        "source", (F.col("last_at") + F.col("timeout")).alias("at"), "session_no", F.lit(False).alias("connected")
    )
    return up.unionByName(down)


def state_map(changes: DataFrame) -> DataFrame:
    """One row with the latest state of every source; the names come from the registry, so the map is small."""
    latest = changes.groupBy(F.lower("source").alias("source")).agg(
        F.max_by("connected", F.struct("at", "session_no")).alias("connected")
    )
    return latest.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "connected")))).alias("source_states")
    )


def health(live: DataFrame) -> DataFrame:
    """``healthy`` only if all configured sources are connected."""
    return live.agg(F.bool_and("connected").alias("all_sources_connected")).withColumn(
        "status", F.when(F.col("all_sources_connected"), F.lit(fv.HEALTHY)).otherwise(F.lit(fv.DEGRADED))
    )


def heartbeat(parsed: DataFrame, accepted: DataFrame, interval_ms: int = fv.HEARTBEAT_MS) -> DataFrame:
    """Cumulative raw, accepted, duplicate and invalid counts at the end of every interval with messages."""
    width = interval_ms * 1000
    beat = floor_div(F.unix_micros("received_at"), width).alias("beat")
    received = parsed.filter("status <> 'oversize'").groupBy(beat).agg(
        F.count(F.lit(1)).alias("raw"),
        F.count(F.when(F.col("status") == "invalid", 1)).alias("invalid"),
    )
    kept = accepted.groupBy(beat).agg(F.count(F.lit(1)).alias("accepted"))
    counts = received.join(kept, "beat", "left").select(
        "beat",
        floor_div(F.col("beat") * width, DAY).alias("day"),
        "raw",
        "invalid",
        F.coalesce("accepted", F.lit(0)).alias("accepted"),
    )
    names = ["raw", "invalid", "accepted"]
    totals = running_total(counts, [], "day", ["beat"], {f"total_{n}": n for n in names})
    return totals.select(
        ((F.col("beat") + 1) * width).alias("at"),
        F.col("total_raw").alias("raw"),
        F.col("total_accepted").alias("accepted"),
        (F.col("total_raw") - F.col("total_invalid") - F.col("total_accepted")).alias("duplicate"),
        F.col("total_invalid").alias("invalid"),
    )


# The counters of a heartbeat line, in its order
LINE = ("raw", "accepted", "duplicate", "invalid", "written", "conflicts", "dead_lettered", "dropped", "attempt_failures",
        "reconnects")


def heartbeat_line(parsed: DataFrame, loaded: DataFrame, found: DataFrame, names: list[str],
                   interval_ms: int = fv.HEARTBEAT_MS, window_ms: int = fv.DEDUP_WINDOW_MS) -> DataFrame:
    """All counters, the live keys and the state of every source at the end of each interval with messages.

    Everything is a sum of changes: a key is +1 when its window opens and -1 when it ends, a source +1 when it connects
    and -1 when it stalls, a failed batch +1 when its last tick has come. So the lines are running totals over one row
    per interval; no key and no source is repeated per interval, and no interval looks anything up. What begins at the
    very end of an interval belongs to the next, what ends there has ended.

    ``loaded``: accepted ticks with ``outcome``, ``failure`` and ``batch_no``; ``found``: ``sessions`` of the same
    messages; ``names``: the configured sources.
    """
    width = interval_ms * 1000
    arrived = F.unix_micros("received_at")

    def begins(at: Column) -> Column:
        return floor_div(at, width)

    def ends(at: Column) -> Column:
        return floor_div(at - 1, width)

    ups = {name.lower(): f"up_{n}" for n, name in enumerate(sorted(names, key=str.lower))}
    sums = [c for c in LINE if c != "duplicate"] + ["live_keys", "messages", *ups.values()]

    def changes(beat: Column, **columns: Column) -> list[Column]:
        filled = [F.coalesce(columns.get(c, F.lit(0)).cast("long"), F.lit(0)).alias(c) for c in sums]
        return [F.struct(beat.alias("beat"), *filled)]

    def summed(rows: DataFrame, *structs: Column) -> DataFrame:
        flat = rows.select(F.explode(F.array(*structs)).alias("c")).select("c.*")
        return flat.groupBy("beat").agg(*[F.sum(c).alias(c) for c in sums])

    one = F.lit(1)
    received = summed(
        parsed.filter("status <> 'oversize'"),
        *changes(begins(arrived), raw=one, messages=one, invalid=F.col("status") == "invalid"),
    )
    outcome = {
        name: F.col("outcome") == value
        for name, value in (("written", "written"), ("conflicts", "conflict"), ("dead_lettered", "dead_lettered"), ("dropped", "dropped"))
    }
    ended = summed(
        loaded,
        *changes(begins(arrived), accepted=one, live_keys=one, **outcome),
        *changes(ends(arrived + window_ms * 1000), live_keys=F.lit(-1)),
    )
    failed = loaded.filter(F.col("failure").isNotNull()).groupBy("source", "batch_no").agg(F.max(arrived).alias("at"))
    attempts = summed(failed, *changes(begins(F.col("at")), attempt_failures=one))
    states = summed(
        found,
        *changes(begins(F.col("first_at")), reconnects=F.col("session_no") > 1,
                 **{column: F.col("source") == name for name, column in ups.items()}),
        *changes(ends(F.col("last_at") + F.col("timeout")),
                 **{column: -(F.col("source") == name).cast("int") for name, column in ups.items()}),
    )
    every = reduce(DataFrame.unionByName, (received, ended, attempts, states)).groupBy("beat").agg(
        *[F.sum(c).alias(c) for c in sums]
    )
    dated = every.withColumn("day", floor_div(F.col("beat") * width, DAY))
    totals = running_total(dated, [], "day", ["beat"], {f"total_{c}": c for c in sums if c != "messages"})
    counters = {c: F.col(f"total_{c}") for c in sums if c != "messages"}
    counters["duplicate"] = counters["raw"] - counters["invalid"] - counters["accepted"]
    words = [
        F.concat(F.lit(f"{name}="), F.when(F.col(f"total_{column}") > 0, F.lit("up")).otherwise(F.lit("down")))
        for name, column in ups.items()
    ]
    return totals.filter("messages > 0").select(
        ((F.col("beat") + 1) * width).alias("at"), *[counters[c].alias(c) for c in LINE],
        counters["live_keys"].alias("live_keys"), F.concat_ws(",", *words).alias("sources"),
    )
