"""Message guard, strict JSON reading per wire format, and payload writing.

Reading runs as a row of small projections. Long expressions are kept in columns of their own instead of being
repeated, so that each generated method stays small enough for the JIT compiler.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import moments
from ..functions.text import canonical_decimal, decimal_from_text, is_blank, plain_decimal, strip

JSON_SPACE = " \t\r\n"

# What a field holds on the wire
TEXT = "text"
NUMBER = "number"
NUMBER_TEXT = "number text"
ISO_TIME = "iso time"
COMPACT_TIME = "compact time"
EPOCH_MILLIS = "epoch millis"

# JSON types each kind accepts; "absent" stands for a missing field, VOID for null
ACCEPTED = {
    TEXT: ["STRING", "VOID", "absent"],
    NUMBER: ["BIGINT", "DECIMAL", "DOUBLE", "absent"],
    NUMBER_TEXT: ["STRING", "VOID", "absent"],
    ISO_TIME: ["STRING", "absent"],
    COMPACT_TIME: ["STRING", "VOID", "absent"],
    EPOCH_MILLIS: ["BIGINT", "absent"],
}
SLOTS = ("symbol", "price", "volume", "time")


@dataclass(frozen=True)
class Field:
    path: str
    kind: str

    @property
    def parent(self) -> str | None:
        return self.path.rsplit(".", 1)[0] if "." in self.path else None


@dataclass(frozen=True)
class WireFormat:
    """One exchange format. ``also_required`` is the slot that, besides the symbol, must not be blank."""

    label: str
    symbol: Field
    price: Field
    volume: Field
    time: Field
    also_required: str
    misses: str
    number_name: str = "number"


# A new exchange format is one more entry here plus a row in the source registry.
FORMATS: dict[str, WireFormat] = {
    fv.ALPHA: WireFormat(
        "Alpha",
        symbol=Field("symbol", TEXT),
        price=Field("price", NUMBER_TEXT),
        volume=Field("volume", NUMBER),
        time=Field("timestamp", ISO_TIME),
        also_required="price",
        misses="symbol or price",
        number_name="price",
    ),
    fv.BETA: WireFormat(
        "Beta",
        symbol=Field("s", TEXT),
        price=Field("p", NUMBER),
        volume=Field("q", NUMBER_TEXT),
        time=Field("ts", EPOCH_MILLIS),
        also_required="volume",
        misses="s or q",
        number_name="quantity",
    ),
    fv.GAMMA: WireFormat(
        "Gamma",
        symbol=Field("instrument.ticker", TEXT),
        price=Field("last", NUMBER),
        volume=Field("size", NUMBER),
        time=Field("time", COMPACT_TIME),
        also_required="time",
        misses="instrument.ticker or time",
    ),
}


def document(payload: Column) -> Column:
    """The payload as a one-element variant array, NULL unless it is one JSON object.

    The parser ignores text after the first value. Inside an array such text must start with a comma (then there
    are two elements) or with ``]``; the second case needs a ``]`` in the payload and is caught by an object
    wrapper, which is only evaluated for payloads that have one.
    """
    boxed = F.try_parse_json(F.concat(F.lit("["), payload, F.lit("]")))
    wrapped = F.try_parse_json(F.concat(F.lit('{"x":'), payload, F.lit("}")))
    is_object = F.substring(F.ltrim(payload, F.lit(JSON_SPACE)), 1, 1) == "{"
    return F.when(is_object & (~payload.contains("]") | wrapped.isNotNull()), boxed)


# The usual spelling: the slots in order, text in ASCII without escapes, numbers without exponent that any reader keeps
# exactly, JSON space between tokens
_SPACE = r"[ \t\r\n]*+"
_PLAIN_TEXT = r"[ !#-\[\]-~]*+"
_PLAIN_NUMBER = r"-?(?:0|[1-9][0-9]{0,14})(?:\.[0-9]{1,18})?"
_PLAIN_INTEGER = r"-?(?:0|[1-9][0-9]{0,17})"
_PLAIN = {NUMBER: f"({_PLAIN_NUMBER})", EPOCH_MILLIS: f"({_PLAIN_INTEGER})"}


def usual_shape(form: WireFormat) -> str | None:
    """A pattern of the format's usual spelling with one group per slot; nothing if two slots share an outer field."""
    fields = [getattr(form, slot) for slot in SLOTS]
    if len({field.path.split(".")[0] for field in fields}) < len(fields):
        return None
    members = []
    for field in fields:
        member = _PLAIN.get(field.kind, f'"({_PLAIN_TEXT})"')
        for n, name in enumerate(reversed(field.path.split("."))):
            member = (rf"\{{{_SPACE}{member}{_SPACE}\}}" if n else member)
            member = f'"{re.escape(name)}"{_SPACE}:{_SPACE}{member}'
        members.append(member)
    inside = f"{_SPACE},{_SPACE}".join(members)
    return rf"^\{{{_SPACE}{inside}{_SPACE}\}}{_SPACE}\z"


def _usual(messages: DataFrame, formats: dict[str, WireFormat]) -> DataFrame:
    """Add ``usual``: an array of nothing and the text of each slot, NULL unless the payload has its usual spelling.

    One pattern reads such a message. The variant of any other is built and asked slot by slot, at several times the cost."""
    groups = "".join(f'"${n + 1}' for n in range(len(SLOTS)))

    def spelled(form):
        shape = usual_shape(form)
        return None if shape is None else F.regexp_replace("payload", shape, groups)

    # A payload that does not match stays as it is and so starts with a brace.
    is_open = F.col("label").isNotNull() & F.col("payload").startswith("{")
    read = messages.withColumn("usual", F.when(is_open, _by_format(formats, spelled).cast("string")))
    return read.withColumn("usual", F.when(F.col("usual").startswith('"'), F.split("usual", '"')))


def guard(max_bytes: int = fv.MAX_MESSAGE_BYTES) -> Column:
    """Why a message is not handed to a reader, NULL if it is."""
    return (
        F.when(F.octet_length("payload") > max_bytes, F.lit(fv.OVERSIZE_ERROR))
        .when(F.lower("message_type") != fv.TEXT_MESSAGE, F.lit(fv.NON_TEXT_ERROR))
        .when(F.col("format").isNull(), F.lit(fv.UNKNOWN_SOURCE_ERROR))
    )


def _by_format(formats: dict[str, WireFormat], value) -> Column:
    """``value(format)`` of the row's own format; formats whose value is None are left out."""
    chosen = None
    for position, form in enumerate(formats.values()):
        branch = value(form)
        if branch is not None:
            match = F.col("format_no") == position
            chosen = F.when(match, branch) if chosen is None else chosen.when(match, branch)
    return F.lit(None) if chosen is None else chosen


def _json_type(value: Column) -> Column:
    return F.coalesce(F.substring_index(F.schema_of_variant(value), "(", 1), F.lit("absent"))


def _kind_is(formats: dict[str, WireFormat], slot: str, kind: str) -> Column:
    positions = [n for n, form in enumerate(formats.values()) if getattr(form, slot).kind == kind]
    return F.col("format_no").isin(positions) if positions else F.lit(False)


def _extract(messages: DataFrame, formats: dict[str, WireFormat]) -> DataFrame:
    """One variant column per slot, the JSON type of each, and whether a parent of a nested field is no object."""
    def slot_value(slot):
        return _by_format(
            formats, lambda form: F.try_variant_get("doc", f"$[0].{getattr(form, slot).path}", "variant")
        ).alias(slot)

    def parent_value(form):
        parents = [getattr(form, slot).parent for slot in SLOTS]
        found = next((p for p in parents if p), None)
        return None if found is None else F.try_variant_get("doc", f"$[0].{found}", "variant")

    values = messages.select(
        "*",
        F.try_variant_get("doc", "$[1]", "variant").isNotNull().alias("has_more"),
        _by_format(formats, parent_value).cast("variant").alias("parent"),
        *[slot_value(slot) for slot in SLOTS],
    )
    # of a usual message, no type is absent, void or a double
    is_usual = F.col("usual").isNotNull()
    typed = values.select(
        "*",
        _json_type(F.col("parent")).alias("parent_type"),
        *[F.when(is_usual, F.lit("usual")).otherwise(_json_type(F.col(slot))).alias(f"{slot}_type") for slot in SLOTS],
    )
    bad_parent = ~(F.col("parent_type").isin("VOID", "absent") | F.col("parent_type").startswith("OBJECT"))
    bad_type = bad_parent | F.col("has_more") | F.col("doc").isNull()
    for slot in SLOTS:
        bad_type = bad_type | ~_by_format(
            formats, lambda form, slot=slot: F.col(f"{slot}_type").isin(ACCEPTED[getattr(form, slot).kind])
        )
    texts = [
        F.coalesce(F.col("usual")[n + 1], F.try_variant_get(slot, "$", "string")).alias(f"{slot}_text")
        for n, slot in enumerate(SLOTS)
    ]
    judged = typed.select(*typed.columns, (~is_usual & bad_type).alias("bad_type"), *texts)
    return judged.drop("doc", "usual", "parent", "parent_type")


def _convert(fields: DataFrame, formats: dict[str, WireFormat]) -> DataFrame:
    """Slots to numbers and times; NULL where the text or number cannot be read."""
    # A variant keeps numbers with an exponent as doubles, so those are read once more from the payload, exactly.
    number_paths = sorted({
        getattr(form, slot).path
        for form in formats.values()
        for slot in ("price", "volume")
        if getattr(form, slot).kind == NUMBER
    })
    exact = F.from_json("payload", ", ".join(f"{path} {fv.FLIGHT_DECIMAL}" for path in number_paths))
    has_double = (F.col("price_type") == "DOUBLE") | (F.col("volume_type") == "DOUBLE")

    def number(slot: str) -> Column:
        def exact_value(form):
            field = getattr(form, slot)
            return F.col("exact")[field.path] if field.kind == NUMBER else None

        kind = F.col(f"{slot}_type")
        return (
            F.when(_kind_is(formats, slot, NUMBER_TEXT), decimal_from_text(F.col(f"{slot}_text")))
            .when(kind == "absent", F.lit(0).cast(fv.FLIGHT_DECIMAL))
            .when(kind == "DOUBLE", _by_format(formats, exact_value).cast(fv.FLIGHT_DECIMAL))
            .otherwise(F.col(f"{slot}_text").try_cast(fv.FLIGHT_DECIMAL))
        )

    time_text, time_type = F.col("time_text"), F.col("time_type")
    micros = (
        F.when(
            _kind_is(formats, "time", ISO_TIME),
            F.when(time_type == "absent", F.lit(fv.FIRST_MICRO)).otherwise(moments.iso_micros(time_text)),
        )
        .when(_kind_is(formats, "time", COMPACT_TIME), moments.gamma_micros(time_text))
        .when(time_type == "absent", F.lit(0).cast("bigint"))
        .otherwise(moments.millis_to_micros(time_text.try_cast("bigint")))
    )
    seventh = F.when(_kind_is(formats, "time", ISO_TIME), moments.iso_seventh_digit(time_text)).otherwise(F.lit(0))
    ready = fields.select(
        "*",
        F.when(has_double, exact).alias("exact"),
        strip(F.col("symbol_text")).alias("clean_symbol"),
        micros.alias("micros"),
        seventh.alias("seventh"),
    )
    keep = [c for c in fields.columns if c not in SLOTS]
    return ready.select(
        *keep,
        F.col("clean_symbol").alias("symbol"),
        number("price").alias("price"),
        number("volume").alias("volume"),
        F.when(moments.in_calendar(F.col("micros")), F.col("micros")).alias("micros"),
        "seventh",
    )


def _format_error(formats: dict[str, WireFormat]) -> Column:
    """First problem of a row: JSON, missing fields, number text, time text."""
    label = F.col("label")

    def missing(form):
        return is_blank(F.col(f"{form.also_required}_text"))

    def json_number_lost(form):
        lost = F.lit(False)
        for slot in ("price", "volume"):
            if getattr(form, slot).kind == NUMBER:
                lost = lost | F.col(slot).isNull()
        if form.time.kind == ISO_TIME:
            lost = lost | F.col("micros").isNull()
        return lost

    def number_problem(form):
        for slot in ("price", "volume"):
            if getattr(form, slot).kind == NUMBER_TEXT:
                return F.when(
                    F.col(slot).isNull(),
                    F.concat(F.lit(f"{form.label} {form.number_name} '"), F.col(f"{slot}_text"), F.lit("' is invalid")),
                )
        return None

    def time_problem(form):
        if form.time.kind == COMPACT_TIME:
            words = F.concat(F.lit(f"{form.label} time '"), F.col("time_text"), F.lit("' is invalid"))
        elif form.time.kind == EPOCH_MILLIS:
            words = F.lit(f"{form.label} timestamp is invalid")
        else:
            return None
        return F.when(F.col("micros").isNull(), words)

    return F.coalesce(
        F.when(F.col("bad_type") | _by_format(formats, json_number_lost), F.concat(label, F.lit(" JSON is invalid"))),
        F.when(
            (F.col("symbol") == "") | _by_format(formats, missing),
            F.concat(label, F.lit(" payload misses "), _by_format(formats, lambda form: F.lit(form.misses))),
        ),
        _by_format(formats, number_problem).cast("string"),
        _by_format(formats, time_problem).cast("string"),
    )


def read_fields(raw: DataFrame, formats: dict[str, WireFormat] = FORMATS,
                max_bytes: int = fv.MAX_MESSAGE_BYTES) -> DataFrame:
    """Messages that carry their ``format`` to fields: adds guard, label, symbol, price, volume, micros, seventh
    and format_error."""
    position = None
    for n, key in enumerate(formats):
        position = F.when(F.col("format") == key, n) if position is None else position.when(F.col("format") == key, n)
    numbered = raw.select("*", guard(max_bytes).alias("guard"), position.alias("format_no"))
    guarded = numbered.withColumn(
        "label", F.when(F.col("guard").isNull(), _by_format(formats, lambda form: F.lit(form.label)))
    )
    needs_parser = F.col("label").isNotNull() & F.col("usual").isNull()
    documents = _usual(guarded, formats).withColumn("doc", F.when(needs_parser, document(F.col("payload"))))
    checked = _convert(_extract(documents, formats), formats).withColumn(
        "format_error", F.when(F.col("label").isNotNull(), _format_error(formats))
    )
    # Unnesting a one-element array keeps later filters on the error from being pushed below the JSON parser,
    # where the optimizer would parse every document a second time inside the filter.
    found = F.struct("symbol", "price", "volume", "micros", "seventh", "format_error")
    carried = [c for c in guarded.columns if c != "format_no"]
    return checked.select(*carried, F.explode(F.array(found)).alias("found")).select(*carried, "found.*")


def _plain_json(symbol: Column, *parts: Column | str) -> Column:
    """The parts as one text, NULL if one of them is or if the symbol needs an escape; then the general writer is used."""
    texts = [F.lit(part) if isinstance(part, str) else part for part in parts]
    return F.when(symbol.rlike(rf"^{_PLAIN_TEXT}\z"), F.concat(*texts))


def alpha_payload(symbol: Column, price: Column, volume: Column, moment: Column, seventh: Column) -> Column:
    when = moments.iso_text(moment, seventh)
    plain = _plain_json(
        symbol, '{"symbol":"', symbol, '","price":"', canonical_decimal(price), '","volume":', plain_decimal(volume),
        ',"timestamp":"', when, '"}',
    )
    return F.coalesce(plain, F.to_json(F.struct(
        symbol.alias("symbol"),
        canonical_decimal(price).alias("price"),
        F.parse_json(plain_decimal(volume)).alias("volume"),
        when.alias("timestamp"),
    )))


def beta_payload(symbol: Column, price: Column, volume: Column, moment: Column, seventh: Column) -> Column:
    millis = F.unix_millis(moment)
    plain = _plain_json(
        symbol, '{"s":"', symbol, '","p":', plain_decimal(price), ',"q":"', canonical_decimal(volume), '","ts":',
        millis.cast("string"), "}",
    )
    return F.coalesce(plain, F.to_json(F.struct(
        symbol.alias("s"),
        F.parse_json(plain_decimal(price)).alias("p"),
        canonical_decimal(volume).alias("q"),
        millis.alias("ts"),
    )))


def gamma_payload(symbol: Column, price: Column, volume: Column, moment: Column, seventh: Column) -> Column:
    when = moments.gamma_text(moment)
    plain = _plain_json(
        symbol, '{"instrument":{"ticker":"', symbol, '"},"last":', plain_decimal(price), ',"size":', plain_decimal(volume),
        ',"time":"', when, '"}',
    )
    return F.coalesce(plain, F.to_json(F.struct(
        F.struct(symbol.alias("ticker")).alias("instrument"),
        F.parse_json(plain_decimal(price)).alias("last"),
        F.parse_json(plain_decimal(volume)).alias("size"),
        when.alias("time"),
    )))


WRITERS = {fv.ALPHA: alpha_payload, fv.BETA: beta_payload, fv.GAMMA: gamma_payload}


def encode(quotes: DataFrame, into: str = "payload") -> DataFrame:
    """Add the payload of each quote in the wire format its ``format`` column names.

    Needs the columns format, symbol, price, volume (both decimal(38,18)) and event_time. A column event_ticks adds the
    100 ns digit, which only the first format can carry.
    """
    seventh = F.pmod(F.col("event_ticks"), F.lit(10)) if "event_ticks" in quotes.columns else F.lit(0)
    columns = [*(F.col(c) for c in ("symbol", "price", "volume", "event_time")), seventh]
    chosen = None
    for key, write in WRITERS.items():
        match, payload = F.lower("format") == key, write(*columns)
        chosen = F.when(match, payload) if chosen is None else chosen.when(match, payload)
    return quotes.withColumn(into, chosen)
