from decimal import Decimal

from pyspark.sql import functions as F

from quotemill.functions.identity import tick_id
from quotemill.functions.text import canonical_decimal, decimal_from_text, strip

NOON = 639159120001230000  # 2026-06-01T12:00:00.123Z


def ids(spark, rows):
    schema = "n int, source string, symbol string, price decimal(38,18), volume decimal(38,18), event_ticks bigint"
    df = spark.createDataFrame([(i, a, b, Decimal(c), Decimal(d), e) for i, (a, b, c, d, e) in enumerate(rows)], schema)
    cols = [F.col(c) for c in ("source", "symbol", "price", "volume", "event_ticks")]
    return [r[0] for r in df.orderBy("n").select(tick_id(*cols)).collect()]


def test_fixed_vector_and_scale(spark):
    found = ids(spark, [("alpha", "EURUSD", "1.085", "100", NOON), ("alpha", "EURUSD", "1.0850", "100.0", NOON)])
    assert found == ["004bd952-6012-faa7-fc9e-39181e1aaaf2"] * 2


def test_any_field_changes_the_id(spark):
    rows = [
        ("alpha", "USDMXN", "0.732", "64", NOON), ("beta", "USDMXN", "0.732", "64", NOON),
        ("alpha", "USDTRY", "0.732", "64", NOON), ("alpha", "USDMXN", "0.7321", "64", NOON),
        ("alpha", "USDMXN", "0.732", "65", NOON), ("alpha", "USDMXN", "0.732", "64", NOON + 1),
        ("alp", "haUSDMXN", "0.732", "64", NOON),
    ]
    assert len(set(ids(spark, rows))) == len(rows)


def test_canonical_decimal(spark):
    cases = {
        "0": "0", "100": "100", "1.50": "1.5", "0.0001": "0.0001", "0.00001": "1E-05", "0.0000108500": "1.085E-05",
        "0.000000000000000001": "1E-18", "0.0000999": "9.99E-05", "12345678901234567890": "12345678901234567890",
        "0.1": "0.1", "0.00012": "0.00012", "0.000000000012": "1.2E-11",
    }
    df = spark.createDataFrame([(k, Decimal(k)) for k in cases], "k string, n decimal(38,18)")
    assert {r["k"]: r["t"] for r in df.select("k", canonical_decimal(F.col("n")).alias("t")).collect()} == cases


def test_decimal_text(spark):
    cases = {
        "1.5": "1.5", " 1.5 ": "1.5", "\t1.5\n": "1.5", "+1": "1", "-1": "-1", "1-": "-1", "1+": "1", "1 - ": "-1",
        "1,000.5": "1000.5", "1,,0,": "10", ".5": "0.5", "5.": "5", "": None, ".": None, "-": None, "- 1": None,
        "-1-": None, "1e3": None, "1.5,0": None, ",1": None, "0x1": None, "1 1": None, " 1": None, "١": None,
        "007": "7",
    }
    df = spark.createDataFrame([(k,) for k in cases], "k string")
    got = {r["k"]: r["n"] for r in df.select("k", decimal_from_text(F.col("k")).alias("n")).collect()}
    assert got == {k: None if v is None else Decimal(v) for k, v in cases.items()}


def test_strip_is_unicode(spark):
    df = spark.createDataFrame([("  a b \n",), (None,), ("  ",)], "s string")
    assert [r[0] for r in df.select(strip(F.col("s"))).collect()] == ["a b", "", ""]
