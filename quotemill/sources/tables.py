"""A raw feed built from the events and lineitem tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed_values as fv
from ..operators.formats import encode

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"

# Symbols by event type
SYMBOL_OF_EVENT = {
    "click": "EURUSD",
    "view": "GBPUSD",
    "signup": "USDJPY",
    "purchase": "XAUUSD",
    "error": "BTCUSD",
}
SYMBOLS = list(SYMBOL_OF_EVENT.values())
SOURCE_NAMES = ["alpha", "beta", "gamma"]

# Injected defects by divisor of event_id; the first match wins
MALFORMED, ZERO_PRICE, NEGATIVE_VOLUME, BLANK_SYMBOL = 97, 89, 83, 79
# Extended feed only: values that are valid ticks but do not fit the stored table, and guarded messages
LONG_SYMBOL, TINY_PRICE, HUGE_VOLUME = 499, 503, 509
BINARY_MESSAGE, OVERSIZE_MESSAGE = 101, 997
# Copies of valid rows
COPY_AFTER_1S, COPY_AFTER_120S = 100, 250


def _pick(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _format(source: Column) -> Column:
    return F.concat(source, F.lit("-v1"))


def _k(props: Column) -> Column:
    """The number k of an event's properties. Of ``{"k": 5}`` it is cut out; all else goes to the JSON reader, which takes
    about a fifth of the time that making a message takes."""
    digits = F.substring(props, F.lit(len('{"k": ') + 1), F.char_length(props) - len('{"k": }'))
    number = digits.try_cast("bigint")
    # Written as JSON writes it: no sign or zero in front, no space
    is_plain = props.startswith('{"k": ') & props.endswith("}") & (number.cast("string") == digits)
    return F.when(is_plain, number).otherwise(F.from_json(props, "k bigint").k)


# Events of a task, about; few enough that the longest task stays short however many there are
TASK_EVENTS = 25_000


def spread(scan: DataFrame, task_rows: int | None = None) -> DataFrame:
    """A scan whose rows lie in too few of its splits, shuffled so that all tasks share the work on them.

    Reading messages is bound by CPU, so tasks should have equal numbers of rows: as many tasks as cores, or more with
    ``task_rows`` each. A split without the start of a row group is empty, however many splits there are; so the rows of
    each are counted, which reads the ends of the files only.
    """
    split = scan.select(F.spark_partition_id().alias("split")).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    rows, most = split.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.max("rows"), F.lit(0))).first()
    tasks = scan.sparkSession.sparkContext.defaultParallelism
    if task_rows is not None:
        tasks = max(tasks, -(-rows // task_rows))
    return scan.repartition(tasks) if most * tasks > 1.5 * rows else scan


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet"), TASK_EVENTS)


def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"]
    return spread(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*columns))


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The pattern matches a single file as well as a folder of files.
    return spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events.parquet*")


def raw_from_events(events: DataFrame, extended: bool = False) -> DataFrame:
    """One message per event plus the copies; no shuffle, works on batch and streaming frames."""
    event_id = F.col("event_id")

    def every(divisor: int) -> Column:
        return event_id % divisor == 0

    symbol = F.coalesce(*[
        F.when(F.col("event_type") == kind, F.lit(name)) for kind, name in SYMBOL_OF_EVENT.items()
    ])
    price = F.col("value").cast("decimal(18,2)").cast(fv.FLIGHT_DECIMAL)
    defect = (
        F.when(every(MALFORMED), "malformed")
        .when(every(ZERO_PRICE), "zero price")
        .when(every(NEGATIVE_VOLUME), "negative volume")
        .when(every(BLANK_SYMBOL), "blank symbol")
        .when(price <= 0, "value")
    )
    if extended:
        defect = (
            F.when(every(OVERSIZE_MESSAGE), "oversize")
            .when(every(BINARY_MESSAGE), "binary")
            .when(defect.isNotNull(), defect)
            .when(every(LONG_SYMBOL), "long symbol")
            .when(every(TINY_PRICE), "tiny price")
            .when(every(HUGE_VOLUME), "huge volume")
        )
    defect_is = F.col("defect")
    quotes = events.select(
        "event_id",
        _pick(F.col("user_id") % 3, SOURCE_NAMES).alias("source_name"),
        symbol.alias("symbol"),
        price.alias("price"),
        _k(F.col("props")).alias("k"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.coalesce(defect, F.lit("none")).alias("defect"),
    ).select(
        "event_id",
        "source_name",
        _format(F.col("source_name")).alias("format"),
        F.when(defect_is == "blank symbol", F.lit("  "))
        .when(defect_is == "long symbol", F.repeat("symbol", F.lit(6)))
        .otherwise(F.col("symbol"))
        .alias("symbol"),
        F.when(defect_is == "zero price", F.lit(0).cast(fv.FLIGHT_DECIMAL))
        .when(defect_is == "tiny price", F.lit("0.00000000001").cast(fv.FLIGHT_DECIMAL))
        .otherwise(F.col("price"))
        .alias("price"),
        F.when(defect_is == "negative volume", F.lit(-1).cast(fv.FLIGHT_DECIMAL))
        .when(defect_is == "huge volume", F.lit("1234567890123456789").cast(fv.FLIGHT_DECIMAL))
        .otherwise(((F.col("k") + 1) * 1000).cast(fv.FLIGHT_DECIMAL))
        .alias("volume"),
        # Beta and Gamma carry milliseconds only.
        F.date_trunc("millisecond", "ts").alias("event_time"),
        (F.col("ts") + F.expr("interval 1 second")).alias("received_at"),
        "defect",
    )
    has_copies = F.col("defect").isin("none", "long symbol", "tiny price", "huge volume")
    return (
        encode(quotes)
        .select(
            "source_name",
            F.when(defect_is == "malformed", F.lit("{not-json}"))
            .when(defect_is == "oversize", F.rpad("payload", fv.MAX_MESSAGE_BYTES + 1, " "))
            .otherwise(F.col("payload"))
            .alias("payload"),
            F.when(defect_is == "binary", F.lit("binary")).otherwise(F.lit(fv.TEXT_MESSAGE)).alias("message_type"),
            "received_at",
            (event_id * 10).alias("seq"),
            F.explode(F.array(
                F.lit(0),
                F.when(has_copies & every(COPY_AFTER_1S), F.lit(1)),
                F.when(has_copies & every(COPY_AFTER_120S), F.lit(120)),
            )).alias("delay"),
        )
        .filter(F.col("delay").isNotNull())
        .select(
            "source_name",
            "payload",
            "message_type",
            F.timestamp_micros(F.unix_micros("received_at") + F.col("delay") * 1_000_000).alias("received_at"),
            (F.col("seq") + F.when(F.col("delay") == 120, 2).otherwise(F.col("delay"))).alias("seq"),
        )
    )


def raw_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """One message per order line, for volume."""
    source = _pick(F.col("l_suppkey") % 3, SOURCE_NAMES)
    quotes = lineitem.select(
        source.alias("source_name"),
        _format(source).alias("format"),
        _pick(F.col("l_partkey") % 5, SYMBOLS).alias("symbol"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast(fv.FLIGHT_DECIMAL).alias("price"),
        (F.col("l_quantity").cast("decimal(18,0)") * 1000).cast(fv.FLIGHT_DECIMAL).alias("volume"),
        F.timestamp_micros(
            F.unix_micros(F.col("l_shipdate").cast("timestamp")) + F.col("l_orderkey") * 1000
        ).alias("event_time"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
    )
    return encode(quotes).select(
        "source_name",
        "payload",
        F.lit(fv.TEXT_MESSAGE).alias("message_type"),
        (F.col("event_time") + F.expr("interval 1 second")).alias("received_at"),
        "seq",
    )
