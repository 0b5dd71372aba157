"""Time expressions. Moments travel as microseconds since 1970 plus a 100 ns digit."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as fv

# The usual spelling, and every accepted one
_ISO_FULL = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,16})?"
    r"(?:Z|[+-](?:0[0-9]|1[0-4]):[0-5][0-9])$"
)
_ISO_SHAPE = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"(?:T[0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,16})?)?(?:Z|[+-](?:0[0-9]|1[0-4])(?::[0-5][0-9])?)?)?$"
)
_GAMMA_SHAPE = r"^[0-9]{8} [0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}$"


def in_calendar(micros: Column) -> Column:
    """True in years 1 to 9999."""
    return micros.between(F.lit(fv.FIRST_MICRO), F.lit(fv.LAST_MICRO))


def iso_micros(text: Column) -> Column:
    """ISO 8601 text to microseconds, NULL if it has another shape. Text without an offset is UTC."""
    with_seconds = F.regexp_replace(text, r"(T[0-9]{2}:[0-9]{2})((?:Z|[+-].*)?)$", "$1:00$2")
    with_minutes = F.regexp_replace(with_seconds, r"(T.*[+-][0-9]{2})$", "$1:00")
    return (
        F.when(text.rlike(_ISO_FULL), F.unix_micros(text.try_cast("timestamp")))
        .when(text.rlike(_ISO_SHAPE), F.unix_micros(with_minutes.try_cast("timestamp")))
    )


def iso_seventh_digit(text: Column) -> Column:
    """The 100 ns digit of ISO 8601 text, 0 if it has fewer fraction digits."""
    return F.coalesce(F.regexp_extract(text, r"\.[0-9]{6}([0-9])", 1).try_cast("int"), F.lit(0))


def gamma_micros(text: Column) -> Column:
    """Text in exactly the compact UTC form to microseconds, else NULL."""
    spaced = F.concat(
        F.substring(text, 1, 4), F.lit("-"), F.substring(text, 5, 2), F.lit("-"), F.substring(text, 7, 15)
    )
    return F.when(text.rlike(_GAMMA_SHAPE), F.unix_micros(spaced.try_cast("timestamp")))


def millis_to_micros(millis: Column) -> Column:
    """Epoch milliseconds to microseconds, NULL outside years 1 to 9999."""
    low, high = fv.FIRST_MICRO // 1000, fv.LAST_MICRO // 1000
    return F.when(millis.between(F.lit(low), F.lit(high)), millis * 1000)


def tick_count(micros: Column, seventh_digit: Column) -> Column:
    """100 ns units since year 1."""
    return micros * fv.TICKS_PER_MICRO + seventh_digit + F.lit(fv.TICKS_AT_UNIX_EPOCH)


def iso_text(moment: Column, seventh_digit: Column | None = None) -> Column:
    """UTC timestamp as ISO 8601 text with seven fraction digits."""
    digit = F.lit("0") if seventh_digit is None else seventh_digit.cast("string")
    return F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), digit, F.lit("+00:00"))


def gamma_text(moment: Column) -> Column:
    """UTC timestamp in the compact form with milliseconds."""
    return F.date_format(moment, fv.GAMMA_TIME_PATTERN)


def floor_div(value: Column, step: int | Column) -> Column:
    """Integer division that rounds down; exact, unlike a division of doubles."""
    step = F.lit(step) if isinstance(step, int) else step
    return F.call_function("div", value - F.pmod(value, step), step)
