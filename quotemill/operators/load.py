"""The stored tick table: constraint check, batch routing, idempotent append, load outcomes."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import fixed_values as fv
from ..functions.moments import floor_div
from ..schemas import MARKET_TICKS, TABLE_PARTITIONS
from ..session import NO_ID_DICTIONARY, materialize
from . import compaction
from .dedup import first_per_id

# Messages of the constraints, as the stored table reports them
TOO_LONG = "value too long for type character varying({})"
OVERFLOW = "numeric field overflow"
IS_NULL = 'null value in column "{}" violates not-null constraint'
CHECK_FAILED = 'new row violates check constraint "market_ticks_{}_check"'
VIOLATION = "ConstraintViolation"

# Folder lists up to this length are read folder by folder; names outside the pattern are escaped in paths
FOLDER_LIMIT = 1_000
PLAIN_NAME = re.compile(r"[a-z0-9_.-]+")


def violation(price: Column, volume: Column) -> Column:
    """The first constraint a tick would break in the stored table, NULL if none. Takes the numbers as they are stored:
    rounded, NULL where they do not fit."""
    required = ["id", "source", "symbol", "price", "volume", "event_time", "received_at"]
    return F.coalesce(
        *[F.when(F.col(c).isNull(), F.lit(IS_NULL.format(c))) for c in required],
        F.when(F.char_length("source") > fv.SOURCE_CHARS, F.lit(TOO_LONG.format(fv.SOURCE_CHARS))),
        F.when(F.char_length("symbol") > fv.SYMBOL_CHARS, F.lit(TOO_LONG.format(fv.SYMBOL_CHARS))),
        F.when(price.isNull() | volume.isNull(), F.lit(OVERFLOW)),
        F.when(price <= 0, F.lit(CHECK_FAILED.format("price"))),
        F.when(volume < 0, F.lit(CHECK_FAILED.format("volume"))),
    )


def check_constraints(ticks: DataFrame) -> DataFrame:
    """Add ``violation``."""
    # In columns of their own the numbers are rounded once, not for every constraint that looks at them.
    rounded = ticks.withColumns({f"_{c}": F.col(c).try_cast(fv.STORED_DECIMAL) for c in ("price", "volume")})
    return rounded.select(*ticks.columns, violation(F.col("_price"), F.col("_volume")).alias("violation"))


def assign_batches(ticks: DataFrame, batch_size: int = fv.BATCH_SIZE) -> DataFrame:
    """Add ``batch_no``: consecutive blocks of the arrival sequence of a source.

    The sequence number is unique within a source, so a block holds at most ``batch_size`` ticks. No shuffle.
    """
    return ticks.withColumn("batch_no", floor_div(F.col("seq"), batch_size))


def route(checked: DataFrame, scope: str = "batch") -> DataFrame:
    """Add ``failure``: the violation that sends a row to the dead letter, NULL for rows to load.

    In ``batch`` scope one bad row fails all rows of its (source, batch_no); in ``row`` scope only itself. Bad rows
    are few: their batches are stored, so that their size is known, and joined back without a shuffle of the ticks
    while they are small enough to broadcast. The ticks are neither windowed nor collected.
    """
    if scope == "row":
        return checked.withColumn("failure", F.col("violation"))
    failed = (
        checked.filter(F.col("violation").isNotNull())
        .groupBy("source", "batch_no")
        .agg(F.min_by("violation", F.struct("received_at", "seq")).alias("failure"))
    )
    return checked.join(materialize(failed, "failed-batches"), ["source", "batch_no"], "left")


def failed_batches(routed: DataFrame) -> DataFrame:
    """(source, batch_no) of the batches whose write fails: one failed attempt each, as a violation is permanent."""
    return routed.filter(F.col("failure").isNotNull()).select("source", "batch_no").distinct()


def table_row(ticks: DataFrame) -> DataFrame:
    """Ticks in the column types of the stored table, plus its folder columns."""
    return ticks.select(
        "id",
        "symbol",
        F.col("price").cast(fv.STORED_DECIMAL).alias("price"),
        F.col("volume").cast(fv.STORED_DECIMAL).alias("volume"),
        "event_time",
        "received_at",
        F.current_timestamp().alias("persisted_at"),
        F.to_date("event_time").alias("event_date"),
        "source",
    )


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def table_schema() -> str:
    """Columns of the stored table with the folder columns last."""
    return MARKET_TICKS.replace("source string, ", "") + ", " + TABLE_PARTITIONS


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The stored table; empty if nothing was loaded yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], table_schema())
    return compaction.current(spark, path, spark.read.schema(table_schema()).parquet(path))


def compact_table(spark: SparkSession, path: str, before: date, file_rows: int = compaction.FILE_ROWS) -> int:
    """Merge the load folders of the days before ``before``, none of which may be loaded again."""
    return compaction.compact(spark, path, table_schema(), before, file_rows=file_rows)


def folder_list(new: DataFrame) -> tuple[list[tuple[date, str]] | None, int | None]:
    """The (event_date, source) folders that ids of ``new`` can be stored in, nothing if there are too many to name or if a
    name is written differently in a path; and the number of rows of ``new``, nothing if there are too many folders."""
    days = new.groupBy(F.to_date("event_time").alias("day"), "source").agg(F.count(F.lit(1)).alias("rows"))
    found = days.limit(FOLDER_LIMIT + 1).collect()
    if len(found) > FOLDER_LIMIT:
        return None, None
    rows = sum(row["rows"] for row in found)
    if not all(PLAIN_NAME.fullmatch(row["source"]) for row in found):
        return None, rows
    return [(row["day"], row["source"]) for row in found], rows


def read_named(spark: SparkSession, path: str, folders: list[tuple[date, str]]) -> DataFrame:
    """The stored rows in some folders. Each day is listed once, whatever the number of its sources."""
    sources: dict[date, set[str]] = {}
    for day, source in folders:
        sources.setdefault(day, set()).add(source)
    present_folders = []
    for day, names in sources.items():
        pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/event_date={day.isoformat()}/source=*")
        found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
        kept = {status.getPath().getName().split("=", 1)[1] for status in found} & names
        present_folders += [f"{path}/event_date={day.isoformat()}/source={name}" for name in sorted(kept)]
    if not present_folders:
        return spark.createDataFrame([], table_schema())
    found = spark.read.schema(table_schema()).option("basePath", path).parquet(*present_folders)
    return compaction.current(spark, path, found)


def read_folders(spark: SparkSession, path: str, new: DataFrame) -> DataFrame:
    """The stored rows that can hold ids of ``new``: those in its (event_date, source) folders.

    A short folder list, as a micro-batch has, is read directly, so the rest of the table is not even listed. For a
    long one the whole table is read and joined with the list.
    """
    folders, _ = folder_list(new)
    return candidates(read_table(spark, path), new) if folders is None else read_named(spark, path, folders)


def absent(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose id is not stored."""
    return new.join(stored.select("id"), "id", "left_anti")


def present(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose id is stored already."""
    return new.join(stored.select("id"), "id", "left_semi")


def candidates(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The part of the stored table that can hold ids of ``new``.

    The event time and source are part of the id, so an equal id lies in the same (event_date, source) folder. The
    folders are few; when their list is small enough to broadcast, Spark prunes the scan with it at run time.
    """
    folders = new.select(F.to_date("event_time").alias("event_date"), "source").distinct()
    return stored.join(folders, ["event_date", "source"], "left_semi")


def load_outcome(routed: DataFrame, stored: DataFrame) -> DataFrame:
    """Add ``outcome`` to accepted ticks: written, conflict or dead_lettered, without writing anything.

    The earliest live row of an id is written unless the id is stored. Accepted rows of one id are a window apart, so
    a ranked group is bounded by time. The rank and the lookup of stored ids share one shuffle by id.
    """
    earlier = Window.partitionBy("id").orderBy("received_at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    is_live = F.col("failure").isNull()
    ranked = routed.withColumn("_nth", F.count(F.when(is_live, 1)).over(earlier))
    known = candidates(stored, routed.filter(is_live)).select("id", F.lit(True).alias("_stored"))
    return ranked.join(known, "id", "left").select(
        *routed.columns,
        F.when(~is_live, F.lit("dead_lettered"))
        .when((F.col("_nth") == 1) & F.col("_stored").isNull(), F.lit("written"))
        .otherwise(F.lit("conflict"))
        .alias("outcome"),
    )


def append_ticks(ticks: DataFrame, path: str, load_id: str) -> dict[str, int]:
    """Insert the ticks whose id is not stored; stored rows stay as they are.

    Returns the attempted, written and conflict counts; what is written is counted in the footers of the files that the
    load has left, so the new rows are computed once. Rows go to folders of their own ``load_id`` and replace
    them, and rows of the same ``load_id`` do not count as stored. So repeating a load, also one that broke off
    half-way, gives the same table and the same counts. Two loads must not run at the same time.
    """
    spark = ticks.sparkSession
    folders, attempted = folder_list(ticks)

    def held() -> DataFrame:
        return candidates(read_table(spark, path), ticks) if folders is None else read_named(spark, path, folders)

    new = absent(first_per_id(ticks), held().filter(F.col("load_id") != load_id))
    (
        # Gathers the rows of a folder into files of a good size, and splits folders that are too large for one task.
        table_row(new).withColumn("load_id", F.lit(load_id)).hint("rebalance", "event_date", "source")
        .sortWithinPartitions("event_date", "source", "symbol", F.desc("event_time"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option(*NO_ID_DICTIONARY)
        .partitionBy("event_date", "source", "load_id")
        .parquet(path)
    )
    if attempted is None:
        attempted = ticks.count()
    written = held().filter(F.col("load_id") == load_id).count()
    return {"attempted": attempted, "written": written, "conflicts": attempted - written}
