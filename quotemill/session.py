"""Session settings and shared work folders."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Result-relevant settings; everything else is left to the cluster.
REQUIRED = {
    # Wall-clock text has no zone of its own, so all text <-> time conversions use UTC.
    "spark.sql.session.timeZone": "UTC",
    # A repeated JSON key keeps its last value instead of failing the document.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    # HotSpot never compiles methods above 8000 bytes of bytecode. Reading three wire formats makes such methods in
    # whole-stage code; above this limit a stage runs as separate, compilable projections instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


# Of Parquet's writer, for columns named id
NO_ID_DICTIONARY = ("parquet.enable.dictionary#id", "false")


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings that results depend on."""
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "quotemill", cpus: str = "*", memory: str = "8g", shuffle: int = 8) -> SparkSession:
    """A local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder on storage that every executor can reach."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = os.path.join(tempfile.gettempdir(), "quotemill-work")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that functions on rows can be imported there."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, str(file.relative_to(package.parent)))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(application)


_scopes = threading.local()


@contextmanager
def scratch(spark: SparkSession):
    """Delete the frames materialized inside the block when it ends; their results must be written by then."""
    outer = getattr(_scopes, "paths", None)
    _scopes.paths = paths = []
    try:
        yield
    finally:
        _scopes.paths = outer
        path_of = spark._jvm.org.apache.hadoop.fs.Path
        for path in paths:
            path_of(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path_of(path), True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared work folder and read it back, which cuts its lineage.

    Ids are digits of a hash: Snappy leaves them as long as they are, Zstandard halves them. Nearly all differ, so no
    dictionary of them is tried."""
    spark = df.sparkSession
    path = work_folder(spark, label)
    if getattr(_scopes, "paths", None) is not None:
        _scopes.paths.append(path)
    df.write.option("compression", "zstd").option(*NO_ID_DICTIONARY).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
