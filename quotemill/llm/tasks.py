"""What all operators here share: code on the executors, Arrow output of tasks, numbered rows, safe joins."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this library to the executors, once per application, so that tasks import it instead of copying closures."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp()) / f"{root.name}_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, str(file.relative_to(root.parent)))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(application)


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]]) -> DataFrame:
    """Apply ``make()(columns)`` to every Arrow batch; ``make`` runs once per task. Columns are Python lists."""
    ship(df.sparkSession)
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            # slices keep the Python objects of wide rows small
            for start in range(0, batch.num_rows, 1024):
                out = work(batch.slice(start, 1024).to_pydict())
                yield pa.RecordBatch.from_pydict({f.name: pa.array(out[f.name], f.type) for f in arrow}, schema=arrow)

    return df.mapInArrow(run, schema)


def row_numbers() -> Iterator[int]:
    """Numbers that no other task of the stage gives out: the partition in the high bits, a count in the low ones."""
    number = TaskContext.get().partitionId() << 36
    while True:
        yield number
        number += 1


def texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text) alone, whatever else the table carries; a null text counts as empty."""
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    )


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` for a join in which neither side may be broadcast, whatever size Spark takes it for.

    Spark counts an explode as one row for one, and a work table as its file: the compressed numbers of few columns. What
    is broadcast passes through the driver, so sides that grow with the input and that Spark takes for small are sorted."""
    return df.hint("merge")


def same(left: Column, right: Column) -> Column:
    """Equality under which null equals null."""
    return left.eqNullSafe(right)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
