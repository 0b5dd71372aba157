"""Text and number-text expressions.

Each argument is used as few times as possible: an argument that is itself a long expression is repeated in the
generated code for every use.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as fv


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends; NULL becomes empty text."""
    trimmed = F.when(text.rlike("^[!-~]+$"), text).otherwise(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    return F.coalesce(trimmed, F.lit(""))


def is_blank(text: Column) -> Column:
    """True for NULL, empty or white-space text."""
    return ~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


# One optional sign on either side, commas anywhere between the first digit and the point, no exponent.
_NUMBER_SHAPE = (
    r"^[\t-\r ]*(?:[+-]?(?:[0-9][0-9,]*(?:\.[0-9]*)?|\.[0-9]+)[\t-\r ]*"
    r"|(?:[0-9][0-9,]*(?:\.[0-9]*)?|\.[0-9]+)[\t-\r ]*[+-][\t-\r ]*)$"
)


def decimal_from_text(text: Column) -> Column:
    """Invariant decimal text to a number, NULL if the text is not one."""
    bare = F.regexp_replace(text, r"[\t-\r ,+]", "")
    signed = F.regexp_replace(bare, r"^([0-9.]+)-$", "-$1")
    return (
        F.when(text.rlike(r"^[0-9]+(?:\.[0-9]+)?$"), text.try_cast(fv.FLIGHT_DECIMAL))  # the usual spelling
        .when(text.rlike(_NUMBER_SHAPE), signed.try_cast(fv.FLIGHT_DECIMAL))
    )


def plain_decimal(number: Column) -> Column:
    """Decimal text without insignificant zeros, never in scientific form."""
    # The text always has a point. Trimming given characters costs many times what a pattern costs.
    return F.regexp_replace(number.cast("string"), r"\.?0+$", "")


def canonical_decimal(number: Column) -> Column:
    """Shortest text of a non-negative decimal(38,18): equal values give equal text.

    Values below 0.0001 use scientific form: the 18 fraction digits without outer zeros, and as exponent the
    position of the first of them.
    """
    digits = F.ltrim(F.substring(number.cast("string"), 3, 18), F.lit("0"))
    mantissa = F.regexp_replace(F.rtrim(digits, F.lit("0")), "^(.)(.+)$", "$1.$2")
    scientific = F.concat(mantissa, F.lit("E-"), F.lpad((F.lit(19) - F.length(digits)).cast("string"), 2, "0"))
    small = (number > 0) & (number < F.lit("0.0001").cast(fv.FLIGHT_DECIMAL))
    return F.when(small, scientific).otherwise(plain_decimal(number))
