"""Running totals and carried values over ordered rows, computed per segment and joined with segment totals.

A window over one long key, or over no key at all, would sort all its rows in one task. Here the rows are windowed
per (key, segment), in parallel; only one row per segment is windowed over the whole key.

The inputs are aggregates with a row per time cell, far smaller than the messages. Both steps read them, so they are
stored first; otherwise the messages could be scanned twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize


def running_total(rows: DataFrame, keys: list[str], segment: str, order: list[str],
                  totals: dict[str, str]) -> DataFrame:
    """Add cumulative sums per key in ``order``; ``segment`` must not decrease along ``order``.

    ``totals`` maps new column names to the columns they sum.
    """
    rows = materialize(rows, "segments")
    inside = Window.partitionBy(*keys, segment).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select("*", *[F.sum(col).over(inside).alias(f"_in_{name}") for name, col in totals.items()])
    per_segment = rows.groupBy(*keys, segment).agg(*[F.sum(col).alias(f"_sum_{n}") for n, col in totals.items()])
    offsets = per_segment.select(
        *keys, segment, *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in totals]
    )
    joined = local.join(offsets, [*keys, segment])
    return joined.select(
        *rows.columns, *[(F.col(f"_in_{name}") + F.col(f"_before_{name}")).alias(name) for name in totals]
    )


def previous_value(rows: DataFrame, keys: list[str], segment: str, order: list[str], value: str,
                   name: str) -> DataFrame:
    """Add the value of the preceding row per key, for values that never decrease along ``order``."""
    rows = materialize(rows, "segments")
    inside = Window.partitionBy(*keys, segment).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(segment)
    local = rows.withColumn("_lag", F.lag(value).over(inside))
    carried = rows.groupBy(*keys, segment).agg(F.max(value).alias("_last")).select(
        *keys, segment, F.lag("_last").over(across).alias("_carry")
    )
    joined = local.join(carried, [*keys, segment])
    return joined.select(*rows.columns, F.coalesce("_lag", "_carry").alias(name))
