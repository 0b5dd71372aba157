"""Loss in transit: gaps in the arrival sequence of a source.

A collector numbers what it hands on, so a number that never came was lost on the way. Numbers are compared inside blocks
of ``BLOCK`` consecutive ones, in parallel; between blocks only the first and last number of each matter. No task
sees more than one block of numbers, whatever a source sends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import strip
from .segments import previous_value

BLOCK = 65_536


def missing_ranges(messages: DataFrame, number: Column | None = None, source: Column | None = None) -> DataFrame:
    """(source, first_missing, last_missing, missing) between the first and last number of each source.

    Numbers may come in any order and more than once; a null number is no number. ``number``: ``seq`` unless given."""
    numbered = messages.select(
        F.lower(strip(F.col("source_name") if source is None else source)).alias("source"),
        (F.col("seq") if number is None else number).alias("n"),
    ).where("n IS NOT NULL").distinct().withColumn("block", F.expr(f"n div {BLOCK} - if(n % {BLOCK} < 0, 1, 0)"))
    inside = Window.partitionBy("source", "block").orderBy("n")
    within = numbered.withColumn("previous", F.lag("n").over(inside))
    blocks = numbered.groupBy("source", "block").agg(F.min("n").alias("n"), F.max("n").alias("last"))
    parted = blocks.withColumn("part", F.expr(f"block div {BLOCK} - if(block % {BLOCK} < 0, 1, 0)"))
    across = previous_value(parted, ["source"], "part", ["block"], "last", "previous")
    every = within.select("source", "previous", "n").unionByName(across.select("source", "previous", "n"))
    return every.where("n - previous > 1").select(
        "source", (F.col("previous") + 1).alias("first_missing"), (F.col("n") - 1).alias("last_missing"),
        (F.col("n") - F.col("previous") - 1).alias("missing"),
    )
