"""Content identity."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as fv
from .text import canonical_decimal


def guid_text(digest: Column) -> Column:
    """First 16 bytes of a hex digest as GUID text; the first three groups are little-endian."""
    return F.regexp_replace(
        digest,
        "^(..)(..)(..)(..)(..)(..)(..)(..)(.{4})(.{12}).*$",
        "$4$3$2$1-$6$5-$8$7-$9-$10",
    )


def tick_id(source: Column, symbol: Column, price: Column, volume: Column, event_ticks: Column) -> Column:
    """A name-based id of the five fields: equal fields, equal id, wherever and whenever it is computed."""
    content = F.concat_ws(
        fv.FIELD_SEPARATOR,
        source,
        symbol,
        canonical_decimal(price),
        canonical_decimal(volume),
        event_ticks.cast("string"),
    )
    return guid_text(F.sha2(content, 256))
