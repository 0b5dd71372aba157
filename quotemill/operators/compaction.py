"""Merging the load folders of the stored table.

Every load leaves a folder per (event date, source), so a table fed by small batches has many small files. Once a day is
closed, meaning that no load of it can run again, its folders become one. Rows are dealt to files by ranges of (date,
source, symbol, time), so each file of a large folder holds few symbols, or a stretch of time of one that is frequent: the
statistics in the files tell a reader of an instrument which few of them to open.

A reader sees each row once at every moment, also if the job stops between any two steps:

1. the merged rows are written below ``_compacted/``, which readers of the table do not list;
2. a journal per folder names the loads that the merged folder is to replace; alone it changes nothing;
3. the merged folder is renamed into its place. From now on it is there, so :func:`current` leaves out the loads it replaces;
4. the replaced folders are deleted, then the journal.

:func:`finish` takes up what was left behind: after step 3 it deletes, before it the merged rows are thrown away.
Renaming a folder is one step on HDFS and local file systems; on an object store it is not, and a transactional table
format should be used instead. One compaction at a time, and none while a load of the same days runs.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import NO_ID_DICTIONARY

WORK = "_compacted"
MERGED = "merged-"
FILE_ROWS = 2_000_000


@dataclass(frozen=True)
class Swap:
    """One folder's loads and the merged load that replaces them."""

    day: str
    source: str
    merged: str
    replaced: list[str]

    def folder(self, root: str, load_id: str) -> str:
        return f"{root}/event_date={self.day}/source={self.source}/load_id={load_id}"


class _Files:
    """The file system of a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.make = spark._jvm.org.apache.hadoop.fs.Path
        self.system = self.make(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, pattern: str) -> list[str]:
        return [status.getPath().getName() for status in self.system.globStatus(self.make(pattern)) or []]

    def exists(self, path: str) -> bool:
        return self.system.exists(self.make(path))

    def delete(self, path: str) -> None:
        self.system.delete(self.make(path), True)

    def rename(self, path: str, to: str) -> None:
        if not self.system.rename(self.make(path), self.make(to)):
            raise OSError(f"cannot rename {path} to {to}")

    def write(self, path: str, text: str) -> None:
        out = self.system.create(self.make(path), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, path: str) -> str:
        stream = self.system.open(self.make(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


def _journals(files: _Files, path: str) -> list[tuple[str, Swap]]:
    found = files.names(f"{path}/{WORK}/*.json")
    return [(f"{path}/{WORK}/{name}", Swap(**json.loads(files.read(f"{path}/{WORK}/{name}")))) for name in sorted(found)]


def current(spark: SparkSession, path: str, table: DataFrame) -> DataFrame:
    """``table``, read from ``path``, without loads that a merged one in its place replaces.

    Costs one listing; there are journals only while a compaction runs or after one broke off."""
    files = _Files(spark, path)
    for _, swap in _journals(files, path):
        if files.exists(swap.folder(path, swap.merged)):
            here = (F.col("event_date") == F.lit(date.fromisoformat(swap.day))) & (F.col("source") == swap.source)
            table = table.filter(~(here & F.col("load_id").isin(swap.replaced)))
    return table


def finish(spark: SparkSession, path: str) -> int:
    """Complete or undo what an earlier compaction left behind; the number of folders that were completed."""
    files, done = _Files(spark, path), 0
    for journal, swap in _journals(files, path):
        if files.exists(swap.folder(path, swap.merged)):
            _clean(files, path, journal, swap)
            done += 1
        else:
            files.delete(journal)
    files.delete(f"{path}/{WORK}")
    return done


def _clean(files: _Files, path: str, journal: str, swap: Swap) -> None:
    for load_id in swap.replaced:
        files.delete(swap.folder(path, load_id))
    files.delete(journal)


def compact(spark: SparkSession, path: str, schema: str, before: date, least: int = 2, file_rows: int = FILE_ROWS) -> int:
    """Merge the loads of every (event date, source) before a day that has at least ``least`` of them.

    ``schema``: of the stored table. Returns the number of folders merged. All are merged by one job, in files of about
    ``file_rows``; the swaps are renames."""
    finish(spark, path)
    files = _Files(spark, path)
    table = spark.read.schema(schema).parquet(path).filter(F.col("event_date") < F.lit(before))
    loads: dict[tuple[str, str], list[str]] = {}
    for row in table.select("event_date", "source", "load_id").distinct().collect():
        loads.setdefault((row["event_date"].isoformat(), row["source"]), []).append(row["load_id"])  # folder names
    run = uuid.uuid4().hex
    swaps = [Swap(day, source, MERGED + run, sorted(ids)) for (day, source), ids in sorted(loads.items()) if len(ids) >= least]
    if not swaps:
        return 0
    chosen = spark.createDataFrame([(date.fromisoformat(s.day), s.source) for s in swaps], "event_date date, source string")
    staged = f"{path}/{WORK}/{run}"
    rows = table.join(F.broadcast(chosen), ["event_date", "source"], "left_semi")  # a row per folder
    order = ["event_date", "source", "symbol", F.desc("event_time")]
    (
        rows.withColumn("load_id", F.lit(MERGED + run))
        .select(*table.columns)
        .repartitionByRange(max(1, -(-rows.count() // file_rows)), *order)
        .sortWithinPartitions(*order)
        .write.option(*NO_ID_DICTIONARY).partitionBy("event_date", "source", "load_id")
        .parquet(staged)
    )
    for n, swap in enumerate(swaps):
        journal = f"{path}/{WORK}/{run}-{n}.json"
        files.write(f"{journal}.new", json.dumps(asdict(swap)))
        files.rename(f"{journal}.new", journal)
        files.rename(swap.folder(staged, swap.merged), swap.folder(path, swap.merged))
        _clean(files, path, journal, swap)
    files.delete(f"{path}/{WORK}")
    return len(swaps)
