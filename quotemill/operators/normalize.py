"""Messages to ticks: validation, normalization, identity, accept/reject split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions.identity import tick_id
from ..functions.moments import tick_count
from ..functions.text import strip
from ..schemas import TICK
from ..sources.registry import with_source
from .formats import FORMATS, WireFormat, read_fields


def tick_problem(symbol: Column, source: Column, price: Column, volume: Column, event_ticks: Column) -> Column:
    """The first broken rule of a tick whose texts are already stripped, NULL if all hold."""
    return (
        F.when(symbol == "", F.lit(fv.SYMBOL_EMPTY))
        .when(source == "", F.lit(fv.SOURCE_EMPTY))
        .when(price <= 0, F.lit(fv.PRICE_NOT_POSITIVE))
        .when(volume < 0, F.lit(fv.VOLUME_NEGATIVE))
        .when(event_ticks == 0, F.lit(fv.TIME_UNSET))
    )


def normalize(fields: DataFrame) -> DataFrame:
    """Upper-case symbols, lower-case sources, 100 ns tick count."""
    return fields.withColumns({
        "symbol": F.upper("symbol"),
        "source": F.lower(strip(F.col("source_name"))),
        "event_ticks": tick_count(F.col("micros"), F.col("seventh")),
    })


def with_id(ticks: DataFrame, where: Column) -> DataFrame:
    """Add the content id to the rows that satisfy ``where``."""
    identity = tick_id(*[F.col(c) for c in ("source", "symbol", "price", "volume", "event_ticks")])
    return ticks.withColumn("id", F.when(where, identity))


def parse(raw: DataFrame, sources: DataFrame, formats: dict[str, WireFormat] = FORMATS,
          max_bytes: int = fv.MAX_MESSAGE_BYTES, carry: Sequence[str] = ()) -> DataFrame:
    """Raw messages to parsed rows: the message columns, the tick columns and ``status``/``error``.

    ``carry`` names further columns of ``raw`` that stay as they are, whatever the message holds.

    ``status`` is ``valid``, ``invalid`` (counted as received, with the reason in ``error``) or ``oversize``
    (never counted as received). One narrow pass, no shuffle: the registry is joined by broadcast.
    """
    fields = normalize(read_fields(with_source(raw, sources), formats, max_bytes))
    broken = tick_problem(*[F.col(c) for c in ("symbol", "source", "price", "volume", "event_ticks")])
    checked = fields.withColumn(
        "error",
        F.coalesce(
            F.col("guard"),
            F.col("format_error"),
            F.concat(F.col("label"), F.lit(" tick is invalid: "), broken),
        ),
    )
    status = (
        F.when(F.col("guard") == fv.OVERSIZE_ERROR, F.lit("oversize"))
        .when(F.col("error").isNotNull(), F.lit("invalid"))
        .otherwise(F.lit("valid"))
    )
    identified = with_id(checked, F.col("error").isNull())
    return identified.select(
        "source_name",
        "payload",
        "message_type",
        "received_at",
        "seq",
        status.alias("status"),
        "error",
        "id",
        "symbol",
        "price",
        "volume",
        F.timestamp_micros(F.when(F.col("error").isNull(), F.col("micros"))).alias("event_time"),
        "event_ticks",
        "source",
        *carry,
    )


def ticks(parsed: DataFrame) -> DataFrame:
    """The valid rows as ticks."""
    return parsed.filter(F.col("error").isNull()).select(*TICK)


def rejects(parsed: DataFrame) -> DataFrame:
    """The invalid rows with their reason."""
    return parsed.filter(F.col("status") == "invalid").select("source_name", "payload", "received_at", "seq", "error")


def oversize(parsed: DataFrame) -> DataFrame:
    """Messages above the size limit, with their beginning; they count neither as received nor as invalid."""
    return parsed.filter(F.col("status") == "oversize").select("source_name", "received_at", "seq", "payload")
