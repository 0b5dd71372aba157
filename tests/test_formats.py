from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import T0
from quotemill.operators import formats, normalize
from quotemill.operators.formats import FORMATS, Field, WireFormat

ALPHA = '{"symbol":"nokjpy","price":"14.0625","volume":73000,"timestamp":"2026-06-01T12:00:00.317Z"}'
BETA = '{"s":"CHFPLN","p":4.4375,"q":"91000","ts":1780315200642}'
GAMMA = '{"instrument":{"ticker":"XPTEUR"},"last":918.75,"size":260,"time":"20260601 12:00:00.935"}'
EPOCH = 621355968000000000


def one(raw_rows, sources, source, payload, **kwargs):
    return normalize.parse(raw_rows([(source, payload)]), sources, **kwargs).first()


@pytest.fixture
def errors(raw_rows, sources):
    def run(source, payloads):
        rows = normalize.parse(raw_rows([(source, p) for p in payloads]), sources).orderBy("seq").select("error").collect()
        return [r["error"] for r in rows]

    return run


def test_each_format_gives_the_common_tick(raw_rows, sources):
    rows = normalize.parse(raw_rows([("ALPHA", ALPHA), ("beta", BETA), ("gamma", GAMMA)]), sources)
    got = [(r["source"], r["symbol"], r["price"], r["volume"], r["event_ticks"]) for r in rows.orderBy("seq").collect()]
    base = 639159120000000000
    assert got == [
        ("alpha", "NOKJPY", Decimal("14.0625"), Decimal(73000), base + 3170000),
        ("beta", "CHFPLN", Decimal("4.4375"), Decimal(91000), base + 6420000),
        ("gamma", "XPTEUR", Decimal("918.75"), Decimal(260), base + 9350000),
    ]


def test_strict_json(errors):
    bad = [
        "{not-json}", "", "null", "[]", "5", '"x"', BETA + "x", BETA + "]", BETA + "}", BETA + "," + BETA,
        "[" + BETA + "]", BETA + "] {}", "/**/" + BETA, BETA.replace("}", ",}"), BETA.replace('"', "'"),
        BETA.replace('"CHFPLN"', "5"), BETA.replace("4.4375", '"4.4375"'), BETA.replace("4.4375", "null"),
        BETA.replace('"91000"', "91000"), BETA.replace("1780315200642", "1780315200642.0"),
        BETA.replace("1780315200642", '"1780315200642"'), BETA.replace("1780315200642", "null"),
        BETA.replace("1780315200642", "99999999999999999999"), BETA.replace("4.4375", "true"), BETA + "]}[",
    ]
    assert errors("beta", bad) == ["Beta JSON is invalid"] * len(bad)
    good = [
        " \n" + BETA + "\t", BETA.replace('"ts"', '"x":[1,{"y":2}],"ts"'), BETA.replace('"p"', '"p":0,"p"'),
        BETA.replace("4.4375", "4.4375e0"), BETA.replace("CHFPLN", "GBP]USD"),
    ]
    assert errors("beta", good) == [None] * len(good)


def test_missing_and_invalid_fields(errors):
    assert errors("alpha", [
        '{"price":"1","timestamp":"2026-06-01T12:00:00Z"}',
        '{"symbol":"  ","price":"1","timestamp":"2026-06-01T12:00:00Z"}',
        '{"Symbol":"A","price":"1","timestamp":"2026-06-01T12:00:00Z"}',
        '{"symbol":null,"price":"1","timestamp":"2026-06-01T12:00:00Z"}',
        '{"symbol":"A","price":"1e3","timestamp":"2026-06-01T12:00:00Z"}',
        '{"symbol":"A","price":"1"}',
        '{"symbol":"A","price":"1","timestamp":"12:00"}',
        '{"symbol":"A","price":"1","timestamp":null}',
        '{"symbol":"A","price":"1","timestamp":5}',
        '{"symbol":"A","price":"1","volume":"5","timestamp":"2026-06-01T12:00:00Z"}',
        '{"symbol":"A","price":"0","timestamp":"2026-06-01T12:00:00Z"}',
        '{"symbol":"A","price":"1","volume":-1,"timestamp":"2026-06-01T12:00:00Z"}',
        '{"symbol":"A","price":"1","timestamp":"2026-06-01T12:00:00Z"}',
    ]) == [
        *["Alpha payload misses symbol or price"] * 4,
        "Alpha price '1e3' is invalid",
        "Alpha tick is invalid: Timestamp must be specified",
        *["Alpha JSON is invalid"] * 4,
        "Alpha tick is invalid: Price must be positive",
        "Alpha tick is invalid: Volume must not be negative",
        None,
    ]
    assert errors("beta", [
        '{"s":"A","p":1,"ts":0}', '{"s":"A","p":1,"q":"x","ts":0}', '{"s":"A","p":1,"q":"1","ts":253402300800000}',
        '{"s":"A","q":"1","ts":0}', '{"s":"A","p":1,"q":"1"}', '{"s":"A","p":1,"q":"1","ts":-62135596800000}',
    ]) == [
        "Beta payload misses s or q", "Beta quantity 'x' is invalid", "Beta timestamp is invalid",
        "Beta tick is invalid: Price must be positive", None, "Beta tick is invalid: Timestamp must be specified",
    ]
    assert errors("gamma", [
        '{"instrument":null,"last":1,"time":"20260601 12:00:00.000"}',
        '{"instrument":"A","last":1,"time":"20260601 12:00:00.000"}',
        '{"instrument":{"ticker":5},"last":1,"time":"20260601 12:00:00.000"}',
        '{"instrument":{"ticker":"A"},"last":1}',
        '{"instrument":{"ticker":"A"},"last":1,"time":"20260601 12:00:00"}',
        '{"instrument":{"ticker":"A"},"last":1,"time":"20261301 12:00:00.000"}',
        '{"instrument":{"ticker":"A"},"last":1,"time":"20260601 12:00:00.000"}',
    ]) == [
        "Gamma payload misses instrument.ticker or time", "Gamma JSON is invalid", "Gamma JSON is invalid",
        "Gamma payload misses instrument.ticker or time", "Gamma time '20260601 12:00:00' is invalid",
        "Gamma time '20261301 12:00:00.000' is invalid", None,
    ]


def test_iso_times(raw_rows, sources):
    texts = {
        "2026-06-01T12:00:00Z": 0,
        "2026-06-01T14:00:00+02:00": 0,
        "2026-06-01T14:00:00+02": 0,
        "2026-06-01T12:00Z": 0,
        "2026-06-01T12:00:00": 0,
        "2026-06-01T12:00:00.1234567Z": 1234567,
        "2026-06-01T12:00:00.12345678901Z": 1234567,
        "2026-06-01": -12 * 36_000_000_000,
    }
    rows = [("alpha", '{"symbol":"A","price":"1","timestamp":"%s"}' % t) for t in texts]
    found = normalize.parse(raw_rows(rows), sources).orderBy("seq").collect()
    assert [r["event_ticks"] - 639159120000000000 for r in found] == list(texts.values())
    bad = ["2026-06-01T25:00:00Z", "2026-06-01 12:00:00Z", "2026-6-1T12:00:00Z", "2026-06-01T12:00:00+19:00", "x"]
    rows = [("alpha", '{"symbol":"A","price":"1","timestamp":"%s"}' % t) for t in bad]
    assert {r["error"] for r in normalize.parse(raw_rows(rows), sources).select("error").collect()} == {"Alpha JSON is invalid"}


def test_numbers_do_not_pass_through_double(raw_rows, sources):
    rows = [("beta", BETA.replace("4.4375", n)) for n in ("1.085000000000000012", "1e-5", "1.2345678901234567891e1")]
    got = [r["price"] for r in normalize.parse(raw_rows(rows), sources).orderBy("seq").collect()]
    assert got == [Decimal("1.085000000000000012"), Decimal("0.00001"), Decimal("12.345678901234567891")]


def test_guard_and_unknown_source(raw_rows, sources):
    rows = [
        ("beta", BETA.ljust(65536)), ("beta", BETA.ljust(65537)), ("beta", BETA, 2, 2, "binary"), ("nobody", BETA),
        ("  beta ", BETA),
    ]
    parsed = normalize.parse(raw_rows(rows), sources).orderBy("seq").collect()
    assert [(r["status"], r["error"]) for r in parsed] == [
        ("valid", None), ("oversize", "Message exceeds 65536 bytes"), ("invalid", "Non-text message"),
        ("invalid", "Source is not configured"), ("valid", None),
    ]


def test_a_new_format_is_one_entry(raw_rows, spark):
    from quotemill.config import Source
    from quotemill.sources.registry import registry

    delta = WireFormat("Delta", Field("n", "text"), Field("v", "number"), Field("a", "number"),
                       Field("t", "epoch millis"), "symbol", "n")
    formats_too = {**FORMATS, "delta-v1": delta}
    found = normalize.parse(
        raw_rows([("delta", '{"n":"abc","v":2,"a":3,"t":1000}')]), registry(spark, [Source("delta", "Delta-V1")]),
        formats_too,
    ).first()
    assert (found["symbol"], found["price"], found["event_ticks"]) == ("ABC", Decimal(2), EPOCH + 10_000_000)


def test_split_and_parse_plan(raw_rows, sources):
    parsed = normalize.parse(raw_rows([("beta", BETA), ("beta", "x")]), sources)
    assert normalize.ticks(parsed).count() == 1 and normalize.rejects(parsed).count() == 1
    plan = normalize.ticks(parsed)._jdf.queryExecution().optimizedPlan().toString()
    # Once for the array wrapper and once for the conditional object wrapper; not again in the pushed filter.
    assert plan.count("parseJson(concat") == 2


def test_every_format_writes_what_it_reads(spark, raw_rows, sources):
    ticks = normalize.ticks(normalize.parse(raw_rows([("gamma", GAMMA)]), sources))
    from pyspark.sql import functions as F

    for key, source in (("alpha-v1", "alpha"), ("beta-v1", "beta"), ("gamma-v1", "gamma")):
        payload = formats.encode(ticks.withColumn("format", F.lit(key))).first()["payload"]
        back = one(raw_rows, sources, source, payload)
        assert (back["symbol"], back["price"], back["volume"]) == ("XPTEUR", Decimal("918.75"), Decimal(260))
        assert back["event_time"].microsecond == 935000 and T0.year == back["event_time"].year


def test_the_100_ns_digit_survives_encoding(spark, sources):
    payload = ALPHA.replace(".317Z", ".3171234Z")
    raw = spark.createDataFrame([("alpha", payload, "text", None, 1)], "source_name string, payload string, message_type string, received_at timestamp, seq bigint")
    raw = raw.withColumn("received_at", F.lit("2026-06-01 12:00:01").cast("timestamp"))
    first = normalize.ticks(normalize.parse(raw, sources))
    written = formats.encode(first.withColumn("format", F.lit("alpha-v1")))
    again = normalize.ticks(normalize.parse(raw.drop("payload").crossJoin(written.select("payload")), sources))
    assert [r.id for r in first.collect()] == [r.id for r in again.collect()]
    assert first.first()["event_ticks"] % 10 == 4


USUAL = [
    ("alpha", '{"symbol":"eurusd","price":"1.08525","volume":120000,"timestamp":"2026-06-01T12:00:00.123Z"}'),
    ("alpha", '{ "symbol" : " eur}usd] " , "price":"1,000.50-",\t"volume":-1.50,"timestamp":"2026-06-01T12:00:00.1234567Z" }\n'),
    ("beta", '{"s":"GBPUSD","p":1.2725,"q":"250000","ts":1780315200456}'),
    ("beta", '{"s":"","p":0,"q":" ","ts":-0}'),
    ("gamma", '{"instrument":{"ticker":"XAUUSD"},"last":2405.125,"size":5000,"time":"20260601 12:00:00.789"}'),
    ("gamma", '{"instrument":{ "ticker":"XAUUSD" } ,"last":123456789012345.123456789012345678,"size":-0.0,"time":"x"}'),
]
UNUSUAL = [
    ("alpha", '{"price":"1.08525","symbol":"eurusd","volume":120000,"timestamp":"2026-06-01T12:00:00.123Z"}'),
    ("alpha", '{"symbol":"a\\"b","price":"1","volume":1,"timestamp":"2026-06-01T12:00:00Z"}'),
    ("alpha", '{"symbol":"é","price":"1","volume":1e3,"timestamp":"2026-06-01T12:00:00Z"}'),
    ("alpha", '{"symbol":"A","price":"1","volume":01,"timestamp":"2026-06-01T12:00:00Z"}'),
    ("alpha", '{"symbol":"A","price":"1","volume":1,"timestamp":"2026-06-01T12:00:00Z"}x'),
    ("alpha", '{"symbol":"A","price":"1","volume":1,"timestamp":"2026-06-01T12:00:00Z"},{}'),
    ("alpha", '"a"b"c"d'),
    ("beta", '{"s":"A","p":1.2725,"q":"250000","ts":1780315200456.0}'),
    ("beta", '{"s":"A","p":12345678901234567,"q":"2","ts":1780315200456}'),
    ("beta", '{"s":"A","s":"B","p":1,"q":"2","ts":1780315200456}'),
    ("gamma", '{"instrument":"XAUUSD","last":1,"size":1,"time":"20260601 12:00:00.789"}'),
    ("gamma", None),
]


def test_the_usual_spelling_reads_as_the_parser_reads_it(spark, monkeypatch):
    rows = [(name, payload, "text", f"{name}-v1", seq) for seq, (name, payload) in enumerate(USUAL + UNUSUAL)]
    messages = spark.createDataFrame(rows, "source_name string, payload string, message_type string, format string, seq long")

    def read():
        return sorted(tuple(r) for r in formats.read_fields(messages).drop("payload").collect())

    marked = formats._usual(messages.withColumns({"label": F.lit("x"), "format_no": F.expr(
        "case format when 'alpha-v1' then 0 when 'beta-v1' then 1 else 2 end")}), formats.FORMATS)
    assert [r.seq for r in marked.filter("usual IS NOT NULL").collect()] == list(range(len(USUAL)))
    by_pattern = read()
    monkeypatch.setattr(formats, "usual_shape", lambda form: None)
    assert by_pattern == read()


def test_plain_writers_write_as_the_general_one(spark):
    symbols = ["EURUSD", " a b ", "", "a\"b", "a\\b", "é/€", "a\tb\n", None]
    numbers = ["0", "1.50", "100", "0.00001", "12345678901234567890.123456789012345678", "-7", None]
    frame = spark.createDataFrame(
        [(s, p, v, f) for s in symbols for p in numbers for v in numbers[:3] + [None] for f in formats.FORMATS],
        "symbol string, p string, v string, format string",
    ).selectExpr("symbol", "cast(p as decimal(38,18)) price", "cast(v as decimal(38,18)) volume", "format",
                 "timestamp'2026-06-01 12:00:00.123' event_time")
    written = formats.encode(frame)
    general = formats.encode(frame.withColumn("symbol", F.concat("symbol", F.lit("€")))).withColumn(
        "payload", F.replace("payload", F.lit("€"), F.lit("")))
    key = ["symbol", "price", "volume", "format"]
    left = sorted(map(str, written.filter("symbol not like '%€%'").select(*key[1:], "payload").collect()))
    right = sorted(map(str, general.filter("symbol not like '%€€%'").select(*key[1:], "payload").collect()))
    assert left == right and left
