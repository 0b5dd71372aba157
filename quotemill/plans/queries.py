"""Registered queries. Each reads whole tables and returns plain column types."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .. import fixed_values as fv
from ..config import DEFAULT_SOURCES, Options, Source
from ..functions.identity import tick_id
from ..functions.text import canonical_decimal, decimal_from_text
from ..operators import access, accounting, activity, audit, dedup, formats, load, normalize, sequence
from ..operators.deadletter import append_dead_letters, dead_letters, read_dead_letters, write_rejects
from ..session import materialize, prepare, work_folder
from ..sources import tables
from ..sources.feeds import stream_messages, union_of
from ..sources.registry import check_formats, check_registry, registry, with_source
from ..streaming import metrics, observed, watermarked
from ..streaming.ingest import Ingest
from ..streaming.writer import COUNTED, BatchWriter
from . import flow

Query = Callable[[SparkSession, str], DataFrame]

# The events of a source lie minutes apart, so activity queries use longer limits than a live feed. The fourth
# source never sends anything.
ACTIVITY_SOURCES = tuple(Source(s.name, s.format, 1_800_000) for s in DEFAULT_SOURCES) + (
    Source("delta", fv.ALPHA, 1_800_000),
)
ACTIVITY_STABILITY_MS = 7_200_000
NEWEST = 100


def _micros(name: str, alias: str) -> Column:
    return F.unix_micros(name).alias(alias)


def _double(name: str) -> Column:
    return F.col(name).cast("double").alias(name)


def _view() -> list:
    """The columns of a tick in types both engines compare alike."""
    return ["id", "source", "symbol", _double("price"), _double("volume"), _micros("event_time", "event_us"),
            _micros("received_at", "received_us")]


def raw_feed(spark: SparkSession, sf_dir: str, extended: bool = False) -> DataFrame:
    return tables.raw_from_events(tables.read_events(prepare(spark), sf_dir), extended)


def _sources(spark: SparkSession, sources=DEFAULT_SOURCES) -> DataFrame:
    check_formats(sources, formats.FORMATS)
    return registry(spark, sources)


def _parsed(spark: SparkSession, sf_dir: str, extended: bool = False) -> DataFrame:
    raw = raw_feed(spark, sf_dir, extended)
    return normalize.parse(raw, _sources(spark))


def _flow(spark: SparkSession, sf_dir: str, extended: bool = False) -> flow.Flow:
    return flow.run(raw_feed(spark, sf_dir, extended))


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted ticks; stored by the de-duplication, so they can be read several times."""
    return _flow(spark, sf_dir).accepted


def _normalized(source: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = raw_feed(spark, sf_dir).filter(F.col("source_name") == source)
        found = normalize.ticks(normalize.parse(raw, _sources(spark)))
        return found.select("seq", "source", "symbol", _double("price"), _double("volume"),
                            _micros("event_time", "event_us"), _micros("received_at", "received_us"))

    return query


def tick_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.ticks(_parsed(spark, sf_dir)).select("seq", "id", "event_ticks")


def decimal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number texts in ten spellings, chosen by event_id, and what they parse to."""
    events = tables.read_events(prepare(spark), sf_dir)
    plain = F.col("value").cast("decimal(18,2)").cast("string")
    spellings = [
        plain, F.concat(F.lit(" "), plain, F.lit("\t")), F.concat(plain, F.lit("-")), F.concat(F.lit("+"), plain),
        F.concat(F.lit("1,0"), plain), F.concat(plain, F.lit("e1")), F.concat(F.lit("- "), plain), F.lit(""),
        F.concat(plain, F.lit(" - ")), F.concat(F.lit("."), (F.col("event_id") % 1000).cast("string")),
    ]
    number_text = F.element_at(F.array(*spellings), (F.col("event_id") % 10 + 1).cast("int"))
    return events.select("event_id", number_text.alias("number_text")).select(
        "event_id", "number_text", decimal_from_text(F.col("number_text")).cast("double").alias("parsed")
    )


def decimal_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical text of event values scaled down by up to seven digits."""
    events = tables.read_events(prepare(spark), sf_dir)
    scales = F.array(*[F.lit(Decimal(1).scaleb(-n)).cast("decimal(10,8)") for n in range(8)])
    scale = F.element_at(scales, (F.col("event_id") % 8 + 1).cast("int"))
    number = (F.col("value").cast("decimal(18,2)") * scale).cast(fv.FLIGHT_DECIMAL)
    return events.select("event_id", F.abs(number).alias("number")).select(
        "event_id", canonical_decimal(F.col("number")).alias("number_text")
    )


def json_strictness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payload in sixteen good and bad spellings, chosen by event_id, and the verdict of the reader."""
    events = tables.read_events(prepare(spark), sf_dir)
    price = F.greatest(F.col("value"), F.lit(0.01)).cast("decimal(18,2)").cast("string")
    good = F.concat(F.lit('{"s":"EURUSD","p":'), price, F.lit(',"q":"5","ts":1704067200000}'))
    variants = [
        good,
        F.concat(good, F.lit("x")),
        F.concat(good, F.lit("]")),
        F.concat(good, F.lit(","), good),
        F.concat(F.lit("["), good, F.lit("]")),
        F.lit(""),
        F.lit("null"),
        F.replace(good, F.lit('"EURUSD"'), F.lit("5")),
        F.replace(good, F.lit('"s":"EURUSD",'), F.lit("")),
        F.replace(good, F.concat(F.lit('"p":'), price), F.lit('"p":null')),
        F.replace(good, F.lit('"'), F.lit("'")),
        F.concat(F.lit("/* */"), good),
        F.replace(good, F.lit("}"), F.lit(",}")),
        F.replace(good, F.lit('"q":"5"'), F.lit('"q":"-1","q":"5"')),
        F.replace(good, F.lit('"ts"'), F.lit('"note":{"a":[1,2]},"ts"')),
        F.concat(F.lit(" \n"), good, F.lit("\t ")),
    ]
    raw = events.select(
        F.lit("beta").alias("source_name"),
        F.element_at(F.array(*variants), (F.col("event_id") % 16 + 1).cast("int")).alias("payload"),
        F.lit(fv.TEXT_MESSAGE).alias("message_type"),
        F.col("ts").cast("timestamp").alias("received_at"),
        F.col("event_id").alias("seq"),
    )
    return normalize.parse(raw, _sources(spark)).select("seq", "status", F.coalesce("error", F.lit("none")).alias("error"))


def message_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages stopped before reading, against the rest."""
    parsed = _parsed(spark, sf_dir, extended=True)
    guarded = F.col("error").isin(fv.OVERSIZE_ERROR, fv.NON_TEXT_ERROR)
    return parsed.groupBy("source_name", "status", F.when(guarded, F.col("error")).otherwise("read").alias("guard")).agg(
        F.count(F.lit(1)).alias("messages")
    )


def tick_rejects_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.rejects(_parsed(spark, sf_dir, extended=True)).groupBy("source_name", "error").agg(
        F.count(F.lit(1)).alias("messages")
    )


def reject_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected messages as stored."""
    path = work_folder(spark, "rejected")
    write_rejects(normalize.rejects(_parsed(spark, sf_dir, extended=True)), path, "batch")
    return spark.read.parquet(path).select("seq", "source_name", _micros("received_at", "received_us"), "error")


def source_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Separate feeds as one; names match the registry ignoring case."""
    raw = raw_feed(spark, sf_dir)
    feeds = [raw.filter(F.col("source_name") == s.name).withColumn("source_name", F.initcap("source_name"))
             for s in DEFAULT_SOURCES]
    configured = check_registry(_sources(spark), formats.FORMATS)
    return with_source(union_of(feeds), configured).groupBy("source_name", "format", "idle_timeout_ms").agg(
        F.count(F.lit(1)).alias("messages")
    )


def dedup_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _flow(spark, sf_dir)
    return dedup.mark(run.ticks, run.accepted).select(
        "seq", "id", _micros("received_at", "received_us"), "is_duplicate"
    )


def dedup_live_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _flow(spark, sf_dir)
    as_of = run.parsed.agg(F.max("received_at").alias("as_of")).first()["as_of"]
    return dedup.live_keys(run.accepted, F.lit(as_of)).select(
        F.unix_micros(F.lit(as_of)).alias("as_of_us"), "live_keys"
    )


def estimated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ids per source and day: the exact number, and whether the one from merged hourly sketches is near it."""
    accepted = _accepted(spark, sf_dir)
    sketches = dedup.key_sketches(accepted, 3_600_000)
    day = F.expr("interval div 24").alias("day")
    estimated = dedup.estimated_keys(sketches, "source", day)
    arrived = F.expr(f"unix_micros(received_at) div {activity.DAY}").alias("day")
    exact = accepted.groupBy("source", arrived).agg(F.count_distinct("id").alias("keys"))
    off = F.abs(F.col("estimate") - F.col("keys")) <= F.ceil(4 * dedup.SKETCH_ERROR * F.col("keys"))
    return exact.join(estimated.withColumnRenamed("keys", "estimate"), ["source", "day"]).select("source", "day", "keys", off.alias("near"))


def lost_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing ranges in the numbers of a collector that lost some events of every source on the way."""
    events = tables.read_events(prepare(spark), sf_dir)
    came = events.filter((F.col("event_id") % 61 > 2) & (F.col("event_id") % 1000 >= 40))
    messages = came.select(
        tables._pick(F.col("event_id") % 3, tables.SOURCE_NAMES).alias("source_name"), F.expr("event_id div 3").alias("seq")
    )
    return sequence.missing_ranges(messages)


def dedup_in_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rows with one id, the earliest."""
    found = dedup.first_per_id(normalize.ticks(_parsed(spark, sf_dir)))
    return found.select("id", "seq", _micros("received_at", "received_us"))


def idempotent_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored table after one load, a repeat of it, and a second load of the same ticks."""
    accepted = _accepted(spark, sf_dir)
    path = work_folder(spark, "ticks")
    for load_id in ("first", "first", "second"):
        load.append_ticks(accepted, path, load_id)
    return load.read_table(spark, path).select(*_view(), "load_id")


def compacted_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored table after four loads and a merge of its folders, and how many loads each folder is left with."""
    accepted = _accepted(spark, sf_dir)
    path = work_folder(spark, "ticks")
    for n in range(4):
        load.append_ticks(accepted.filter(F.col("seq") % 40 < 10 * (n + 1)), path, f"load-{n}")
    last = load.read_table(spark, path).agg(F.max("event_date")).first()[0]
    load.compact_table(spark, path, last + timedelta(days=1))
    table = load.read_table(spark, path)
    folders = table.groupBy("event_date", "source").agg(F.count_distinct("load_id").alias("loads"))
    return table.join(folders, ["event_date", "source"]).select(*_view(), "loads")


def load_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of loading all ticks into a table that holds those of alpha and beta."""
    accepted = _accepted(spark, sf_dir)
    path = work_folder(spark, "ticks")
    load.append_ticks(accepted.filter(F.col("source") != "gamma"), path, "earlier")
    stored = load.read_table(spark, path)
    first = materialize(dedup.first_per_id(accepted), "first")
    held = materialize(load.candidates(stored, first), "held")
    counts = accepted.groupBy("source").agg(F.count(F.lit(1)).alias("attempted"))
    written = load.absent(first, held).groupBy("source").agg(F.count(F.lit(1)).alias("written"))
    known = load.present(first, held).groupBy("source").agg(F.count(F.lit(1)).alias("known"))
    return counts.join(written, "source", "left").join(known, "source", "left").na.fill(0).select(
        "source", "attempted", "written", (F.col("attempted") - F.col("written")).alias("conflicts"),
        F.col("known").alias("stored_ids"),
    )


def resilient_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of one load per source with injected faults, next to what is then stored and buried.

    Alpha passes at the third attempt, the fault of beta is permanent, that of gamma outlasts all retries and its dead
    letter fails as well."""
    accepted = _accepted(spark, sf_dir)
    root = work_folder(spark, "resilient")
    faults = {
        "alpha": [OSError("busy")] * 2,
        "beta": [ValueError("refused")],
        "gamma": [OSError("gone")] * (Options().max_retries + 1),
    }

    def store(ticks: DataFrame, load_id: str) -> dict[str, int]:
        if faults[load_id]:
            raise faults[load_id].pop()
        return load.append_ticks(ticks, f"{root}/ticks", load_id)

    def bury(records: DataFrame, load_id: str, failed_at) -> None:
        if load_id == "gamma":
            raise OSError("full")
        append_dead_letters(records, f"{root}/dead_letter", load_id, failed_at)

    writer = BatchWriter("", "", store=store, bury=bury, sleep=lambda seconds: None)
    counts = [
        (source, *[result[name] for name in COUNTED])
        for source in list(faults)
        for result in [writer.write(accepted.filter(F.col("source") == source), source)]
    ]
    schema = ", ".join(["source string", *[f"{name} bigint" for name in COUNTED]])
    stored = load.read_table(spark, f"{root}/ticks").groupBy("source").agg(F.count(F.lit(1)).alias("stored"))
    letters = read_dead_letters(spark, f"{root}/dead_letter").groupBy(F.col("tick.source").alias("source"))
    buried = letters.agg(F.count(F.lit(1)).alias("buried"))
    return spark.createDataFrame(counts, schema).join(stored, "source", "left").join(buried, "source", "left").na.fill(0)


def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = load.check_constraints(normalize.ticks(_parsed(spark, sf_dir, extended=True)))
    return checked.filter(F.col("violation").isNotNull()).groupBy("source", "violation").agg(
        F.count(F.lit(1)).alias("ticks")
    )


def dead_letter_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that one bad row sends to the dead letter."""
    routed = _flow(spark, sf_dir, extended=True).routed
    return routed.filter(F.col("failure").isNotNull()).groupBy("source", "batch_no", "failure").agg(
        F.count(F.lit(1)).alias("ticks"), F.count("violation").alias("bad_ticks")
    )


def dead_letter_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead letters as stored, one JSON record per tick."""
    from datetime import datetime, timezone

    path, now = work_folder(spark, "dead-letter"), datetime.now(timezone.utc)
    routed = _flow(spark, sf_dir, extended=True).routed.filter(F.col("failure").isNotNull())
    append_dead_letters(dead_letters(routed, F.lit(load.VIOLATION), F.col("failure"), now), path, "batch", now)
    return read_dead_letters(spark, path).select(
        "tick.id", "tick.source", "tick.symbol", _double("tick.price").alias("price"),
        _double("tick.volume").alias("volume"), _micros("tick.timestamp", "event_us"),
        _micros("tick.received_at", "received_us"), "error_type", "error_message",
    )


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _flow(spark, sf_dir, extended=True)
    return accounting.by_source(run.parsed, flow.outcomes(run, flow.empty_table(spark)))


def outcomes_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.long_form(_counts(spark, sf_dir))


def outcome_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = activity.sessions(raw_feed(spark, sf_dir, True), _sources(spark, ACTIVITY_SOURCES))
    run = _flow(spark, sf_dir, extended=True)
    counts = accounting.by_source(run.parsed, flow.outcomes(run, flow.empty_table(spark)))
    return accounting.snapshot(counts, activity.reconnects(found), load.failed_batches(run.routed))


def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The balance with each duplicate explained by an open window, not taken as a difference."""
    run = _flow(spark, sf_dir, extended=True)
    duplicates = dedup.suppressed(run.ticks, run.accepted)
    return accounting.reconcile(
        accounting.by_source(run.parsed, flow.outcomes(run, flow.empty_table(spark)), duplicates)
    )


def heartbeat_10s(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _flow(spark, sf_dir, extended=True)
    return activity.heartbeat(run.parsed, run.accepted)


def heartbeat_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every counter, the live keys and all source states at the end of each interval with messages."""
    run = _flow(spark, sf_dir, extended=True)
    found = activity.sessions(raw_feed(spark, sf_dir, True), _sources(spark, ACTIVITY_SOURCES))
    loaded = materialize(flow.outcomes(run, flow.empty_table(spark)), "loaded")
    return activity.heartbeat_line(run.parsed, loaded, found, [s.name for s in ACTIVITY_SOURCES])


def stored_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The balance of what the continuous job has stored, per source and hour, by fingerprints of the rows."""
    prepare(spark)
    root = work_folder(spark, "ingest")
    raw = tables.raw_from_events(tables.stream_events(spark, sf_dir), extended=True)
    job = Ingest(root, ledger_hours=None)
    job.start(raw, f"{root}/checkpoint").awaitTermination()
    again = normalize.parse(raw_feed(spark, sf_dir, True), _sources(spark))
    return audit.balance(job.fingerprints(again))


def idle_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.idle_gaps(raw_feed(spark, sf_dir), _sources(spark, ACTIVITY_SOURCES))


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.sessions(raw_feed(spark, sf_dir), _sources(spark, ACTIVITY_SOURCES))


def source_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir).select(
        "source", "session_no", "first_at", "last_at", "messages", "ended", "duration"
    )


def flap_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.flap_streaks(_sessions(spark, sf_dir), ACTIVITY_STABILITY_MS)


def reconnects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.reconnects(_sessions(spark, sf_dir))


def _end_of_feed(raw: DataFrame) -> Column:
    return F.lit(raw.agg(F.max(F.unix_micros("received_at")).alias("as_of")).first()["as_of"])


def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each configured source and the overall state at the end of the feed."""
    raw = raw_feed(spark, sf_dir)
    live = activity.liveness(raw, _sources(spark, ACTIVITY_SOURCES), _end_of_feed(raw))
    return live.crossJoin(F.broadcast(activity.health(live)))  # one row


def source_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest state of each source that ever connected, as one line."""
    raw = raw_feed(spark, sf_dir)
    found = activity.sessions(raw, _sources(spark, ACTIVITY_SOURCES), _end_of_feed(raw))
    states = activity.state_map(activity.state_changes(found))
    words = F.transform(
        F.map_entries("source_states"),
        lambda e: F.concat(e["key"], F.lit("="), F.when(e["value"], F.lit("up")).otherwise(F.lit("down"))),
    )
    return states.select(F.array_join(words, ",").alias("sources"))


def _stored(spark: SparkSession, sf_dir: str) -> str:
    """Path of a stored table that the feed was loaded into."""
    path = work_folder(spark, "ticks")
    load.append_ticks(_accepted(spark, sf_dir), path, "feed")
    return path


def instrument_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = load.read_table(spark, _stored(spark, sf_dir))
    return access.instrument_history(table, "alpha", "EURUSD").select(*_view())


def latest_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.latest_stored(spark, _stored(spark, sf_dir), NEWEST).select(*_view())


def latest_per_instrument(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.latest_per_instrument(load.read_table(spark, _stored(spark, sf_dir))).select(*_view())


def replay_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = access.replay_slice(raw_feed(spark, sf_dir).select("source_name", "received_at", "seq"), fv.REPLAY_COUNT)
    return kept.select("source_name", "position", "seq", _micros("received_at", "received_us"))


def _written_and_read(spark: SparkSession, quotes: DataFrame) -> DataFrame:
    """Per format: quotes written in it, and how many of them come back with the same content and id.

    What was sent travels with each message, so nothing is joined. ``quotes``: symbol, price, volume, event_time,
    event_ticks, received_at, seq."""
    every = quotes.withColumn("format", F.explode(F.array(*[F.lit(f) for f in formats.FORMATS])))
    source = F.split_part("format", F.lit("-"), F.lit(1))
    content = ["symbol", "price", "volume", "event_time", "event_ticks"]
    expected = tick_id(source, *[F.col(c) for c in ("symbol", "price", "volume", "event_ticks")])
    written = formats.encode(every).select(
        source.alias("source_name"),
        "payload",
        F.lit(fv.TEXT_MESSAGE).alias("message_type"),
        "received_at",
        "seq",
        F.struct(*content, expected.alias("id")).alias("sent"),
    )
    read = normalize.parse(written, _sources(spark), carry=["sent"])
    same = (F.col("status") == "valid") & (F.col("sent") == F.struct(*content, "id"))
    return read.groupBy("source_name").agg(F.count(F.lit(1)).alias("ticks"), F.count(F.when(same, 1)).alias("same"))


def payload_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tick written in every wire format and read back."""
    return _written_and_read(spark, normalize.ticks(_parsed(spark, sf_dir)))


def payload_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a feed in steps of 100 ns, which only the first format can carry."""
    events = tables.read_events(prepare(spark), sf_dir).filter("value > 0")
    moment = F.col("ts").cast("timestamp")
    quotes = events.select(
        F.lit("EURUSD").alias("symbol"),
        F.col("value").cast("decimal(18,2)").cast(fv.FLIGHT_DECIMAL).alias("price"),
        F.lit(1).cast(fv.FLIGHT_DECIMAL).alias("volume"),
        moment.alias("event_time"),
        (F.unix_micros(moment) * fv.TICKS_PER_MICRO + F.col("event_id") % 10 + fv.TICKS_AT_UNIX_EPOCH).alias("event_ticks"),
        moment.alias("received_at"),
        F.col("event_id").alias("seq"),
    )
    return _written_and_read(spark, quotes)


def stream_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored table filled by the continuous job."""
    prepare(spark)
    root = work_folder(spark, "ingest")
    raw = tables.raw_from_events(tables.stream_events(spark, sf_dir), extended=True)
    job = Ingest(root)
    job.start(raw, f"{root}/checkpoint").awaitTermination()
    return load.read_table(spark, f"{root}/ticks").select(*_view())


def stream_oversize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the continuous job keeps of messages above the size limit."""
    prepare(spark)
    root = work_folder(spark, "ingest")
    raw = tables.raw_from_events(tables.stream_events(spark, sf_dir), extended=True)
    Ingest(root).start(raw, f"{root}/checkpoint").awaitTermination()
    kept = spark.read.parquet(f"{root}/oversize")
    return kept.select("source_name", "seq", _micros("received_at", "received_us"), F.length("payload").cast("long").alias("head"))


def stream_new_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored table after one half of the feed came through one checkpoint and the rest through another.

    The halves are cut between blocks of the arrival sequence, as a block fails as a whole."""
    prepare(spark)
    root = work_folder(spark, "ingest")
    raw = tables.raw_from_events(tables.stream_events(spark, sf_dir), extended=True)
    last = tables.raw_from_events(spark.read.parquet(f"{sf_dir}/events.parquet")).agg(F.max("seq")).first()[0]
    middle = last // 2 // fv.BATCH_SIZE * fv.BATCH_SIZE
    for half, inside in enumerate((F.col("seq") < middle, F.col("seq") >= middle)):
        Ingest(root).start(raw.filter(inside), f"{root}/checkpoint-{half}").awaitTermination()
    return load.read_table(spark, f"{root}/ticks").select(*_view())


def stream_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of one continuous query per source, each with its own progress."""
    prepare(spark)
    root = work_folder(spark, "ingest")
    raw = tables.raw_from_events(tables.stream_events(spark, sf_dir), extended=True)
    jobs = [Ingest(root, s.name) for s in DEFAULT_SOURCES]
    running = [
        job.start(raw.filter(F.col("source_name") == job.stream), f"{root}/checkpoint/{job.stream}") for job in jobs
    ]
    for query in running:
        query.awaitTermination()
    counts = jobs[0].outcomes(spark)
    names = ["raw", "invalid", "oversize", "accepted", "duplicate", "written", "conflicts", "dead_lettered", "dropped",
             "attempt_failures"]
    return counts.groupBy(F.col("stream").alias("source")).agg(*[F.sum(n).alias(n) for n in names])


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after the feed arrived in four parts, with a restart after each."""
    prepare(spark)
    root = work_folder(spark, "ingest")
    landing = f"{root}/landing"
    raw = raw_feed(spark, sf_dir)
    ends = raw.agg(F.min("received_at").alias("lo"), F.max("received_at").alias("hi")).first()
    step = (ends["hi"] - ends["lo"]) / 4
    starts = [ends["lo"] + part * step for part in range(4)]
    at = F.col("received_at")
    part = F.when(at >= F.lit(starts[3]), 3).when(at >= F.lit(starts[2]), 2).when(at >= F.lit(starts[1]), 1).when(at < F.lit(starts[1]), 0)
    dealt = _dealt(raw, part)
    job = Ingest(root, ledger_hours=None)
    for part in range(4):
        dealt.filter(F.col("part") == part).drop("part").write.mode("append").parquet(landing)
        job.start(stream_messages(spark, landing), f"{root}/checkpoint").awaitTermination()
    return job.ledger(spark).select("id", _micros("anchor_at", "anchor_us"))


def stream_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    root = work_folder(spark, "heartbeat")
    raw = tables.raw_from_events(tables.stream_events(spark, sf_dir), extended=True)
    parsed = normalize.parse(raw, _sources(spark))
    parts = metrics.run_in_parts(parsed, metrics.heartbeat_part, f"{root}/parts", f"{root}/checkpoint")
    return metrics.heartbeat_counts(parts)


def stream_all_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session, with a flag for those that have ended."""
    prepare(spark)
    root = work_folder(spark, "sessions")
    raw = tables.raw_from_events(tables.stream_events(spark, sf_dir))
    sources = _sources(spark, ACTIVITY_SOURCES)
    parts = metrics.run_in_parts(
        raw, lambda rows: activity.arrivals(rows, sources), f"{root}/parts", f"{root}/checkpoint"
    )
    return metrics.session_activity(parts)


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that have ended; ``stream_all_sessions`` has the open ones too."""
    return stream_all_sessions(spark, sf_dir).filter("ended").drop("ended")


def _dealt(raw: DataFrame, part: Column) -> DataFrame:
    """The feed as stored once, in a folder per ``part``, so that no part makes or reads the messages of another."""
    spark = raw.sparkSession
    path = work_folder(spark, "feed")
    raw.withColumn("part", part).write.partitionBy("part").parquet(path)
    return spark.read.schema(StructType([*raw.schema.fields, StructField("part", IntegerType())])).parquet(path)


def _in_parts(spark: SparkSession, raw: DataFrame, landing: str, after: Callable[[], None], delayed: int = 0) -> None:
    """Land the feed in four parts of equal time, oldest first, and do something after each. Every ``delayed``-th message
    comes one part later than it should."""
    ends = raw.agg(F.min(F.unix_micros("received_at")).alias("lo"), F.max(F.unix_micros("received_at")).alias("hi")).first()
    step = max((ends["hi"] - ends["lo"]) // 4, 1)
    part = F.expr(f"(unix_micros(received_at) - {ends['lo']}) div {step}")
    if delayed:
        part = part + F.when(F.col("seq") % delayed == 0, 1).otherwise(0)
    dealt = _dealt(raw, F.least(part, F.lit(3)).cast("int"))
    for n in range(4):
        dealt.filter(F.col("part") == n).drop("part").write.mode("append").parquet(landing)
        after()


def stream_two_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval counts after one half of the feed came through one checkpoint and the rest through another."""
    prepare(spark)
    root = work_folder(spark, "heartbeat")
    raw = tables.raw_from_events(tables.stream_events(spark, sf_dir), extended=True)
    for half in range(2):
        parsed = normalize.parse(raw.filter(F.col("seq") % 2 == half), _sources(spark))
        parts = metrics.run_in_parts(parsed, metrics.heartbeat_part, f"{root}/parts", f"{root}/checkpoint-{half}")
    return metrics.heartbeat_counts(parts)


LATE_EVERY, WINDOW_MS = 50, 3_600_000


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts that close behind a watermark, from micro-batches with late messages; none is lost."""
    prepare(spark)
    root = work_folder(spark, "windows")
    landing = f"{root}/landing"

    def run() -> None:
        stream = watermarked.tumbling_counts(stream_messages(spark, landing), _sources(spark), WINDOW_MS)
        metrics.run_in_parts(stream, lambda rows: rows, f"{root}/rows", f"{root}/checkpoint")

    _in_parts(spark, raw_feed(spark, sf_dir, True), landing, run, LATE_EVERY)
    return watermarked.current(metrics.read_parts(spark, f"{root}/rows"), ["at"])


def stream_closed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each source that its own watermark has closed, and those still open."""
    prepare(spark)
    root = work_folder(spark, "sessions")
    landing = f"{root}/landing"

    def run() -> None:
        stream = watermarked.session_activity(stream_messages(spark, landing), _sources(spark, ACTIVITY_SOURCES))
        metrics.run_in_parts(stream, lambda rows: rows, f"{root}/rows", f"{root}/checkpoint")

    _in_parts(spark, raw_feed(spark, sf_dir), landing, run)
    return watermarked.current(metrics.read_parts(spark, f"{root}/rows"), ["first_at", "last_at"])


STALL_MS, SILENT_SECONDS = 1_500, 300


def stream_stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connection changes of the sources: each connects with its messages and is found silent by a timer, without any."""
    prepare(spark)
    root = work_folder(spark, "stalls")
    sources = tuple(Source(s.name, s.format, STALL_MS) for s in DEFAULT_SOURCES)
    raw = tables.raw_from_events(tables.stream_events(spark, sf_dir), extended=True)
    changes = watermarked.connection_changes(raw, _sources(spark, sources))
    query = metrics.start_parts(
        changes, lambda rows: rows, f"{root}/rows", f"{root}/checkpoint", "2 seconds", drop_empty=True
    )

    def all_silent() -> bool:
        if not metrics.has_parts(spark, f"{root}/rows"):
            return False
        states = watermarked.last_states(metrics.read_parts(spark, f"{root}/rows"))
        return states.agg(F.bool_and(~F.col("connected")).alias("all")).first()["all"]

    until = time.monotonic() + SILENT_SECONDS
    try:
        # timers make batches for ever, so the end is seen in the results
        while query.isActive and time.monotonic() < until and not all_silent():
            time.sleep(1)
            if query.lastProgress is None:
                until = time.monotonic() + SILENT_SECONDS  # the first batch reads the messages, however long that takes
    finally:
        metrics.stop_between_batches(query)
    found = metrics.read_parts(spark, f"{root}/rows")
    return found.select("source", "connected", "messages", "by_timer")


def stream_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per source as a listener sees them while interval counts are made; no job counts them."""
    prepare(spark)
    root = work_folder(spark, "observed")
    raw = tables.raw_from_events(tables.stream_events(spark, sf_dir), extended=True)
    listener = observed.Counters()
    query = observed.counted(
        normalize.parse(raw, _sources(spark)), DEFAULT_SOURCES, metrics.heartbeat_part, f"{root}/parts", f"{root}/checkpoint", listener
    )
    try:
        listener.wait_for(query)
    finally:
        spark.streams.removeListener(listener)
    return listener.totals(spark)


def _bulk_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.raw_from_lineitem(tables.read_lines(prepare(spark), sf_dir))


def bulk_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all order lines as ticks, without the way through JSON, and how often each occurs."""
    lines = tables.read_lines(prepare(spark), sf_dir)
    ticks = lines.select(
        tables._pick(F.col("l_suppkey") % 3, tables.SOURCE_NAMES).alias("source"),
        tables._pick(F.col("l_partkey") % 5, tables.SYMBOLS).alias("symbol"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast(fv.FLIGHT_DECIMAL).alias("price"),
        (F.col("l_quantity").cast("decimal(18,0)") * 1000).cast(fv.FLIGHT_DECIMAL).alias("volume"),
        (F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 10 + F.col("l_orderkey") * 10_000
         + F.lit(fv.TICKS_AT_UNIX_EPOCH)).alias("event_ticks"),
    )
    ids = ticks.select(tick_id(*[F.col(c) for c in ("source", "symbol", "price", "volume", "event_ticks")]).alias("id"))
    return ids.groupBy("id").agg(F.count(F.lit(1)).alias("lines"))


def bulk_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole batch job over the order lines."""
    run = flow.run(_bulk_raw(spark, sf_dir))
    counts = accounting.by_source(run.parsed, flow.outcomes(run, flow.empty_table(spark)))
    return counts.select("source", "raw", "invalid", "duplicate", "accepted", "written", "conflict")


def bulk_latest_per_instrument(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = normalize.ticks(normalize.parse(_bulk_raw(spark, sf_dir), _sources(spark)))
    stored = materialize(found.select("id", "source", "symbol", "price", "volume", "event_time"), "ticks")
    newest = access.latest_per_instrument(stored)
    return newest.select("source", "symbol", "id", _double("price"), _double("volume"), _micros("event_time", "event_us"))


def bulk_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative counts per interval over the order lines."""
    run = flow.run(_bulk_raw(spark, sf_dir))
    return activity.heartbeat(run.parsed, run.accepted)


def tick_counts_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: every accepted tick of the feed, counted per source and symbol."""
    return _accepted(spark, sf_dir).groupBy("source", "symbol").agg(F.count(F.lit(1)).alias("ticks"))


QUERIES: dict[str, Query] = {
    "tick_counts_by_source": tick_counts_by_source,
    **{f"tick_normalize_{s.name}": _normalized(s.name) for s in DEFAULT_SOURCES},
    **{
        query.__name__: query
        for query in (
            tick_identity, decimal_text, decimal_canonical, json_strictness, message_guard, tick_rejects_by_reason,
            reject_sink, source_lookup, dedup_window, dedup_live_keys, estimated_keys, lost_messages, dedup_in_batch, idempotent_load, compacted_table,
            load_conflicts, resilient_write, constraint_violations, dead_letter_batches, dead_letter_records, outcomes_by_source,
            outcome_counters, reconciliation, heartbeat_10s, idle_gaps, source_sessions, flap_streaks, reconnects,
            source_health, source_states, instrument_history, latest_ticks, latest_per_instrument, replay_slice,
            payload_roundtrip, payload_ids, stream_ticks, stream_oversize, stream_new_checkpoint, stream_outcomes, stream_dedup, stream_heartbeat, stream_sessions,
            stream_all_sessions, heartbeat_line, stored_audit, stream_two_checkpoints, stream_windows, stream_closed_sessions,
            stream_stalls, stream_observed,
            bulk_identity, bulk_outcomes, bulk_latest_per_instrument, bulk_heartbeat,
        )
    },
}
