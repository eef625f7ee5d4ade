import random

import pytest
from pyspark.sql import functions as F

from codesift.functions import scores, text, urls


def column(spark, values, kind, expression):
    rows = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, v {kind}").repartition(1)
    return [row[0] for row in rows.orderBy("n").select(expression).collect()]


def test_round_follows_binary_value_and_even_ties(spark):
    rng = random.Random(3)
    values = [0.125, 2.675, 1.115, 1.005, 0.285, -2.5, -0.125, 0.0, 1e12 + 0.375, 59.75 / 120 * 100]
    values += [rng.randrange(0, 10**6) / 8 + 0.005 * rng.randrange(3) for _ in range(3000)]
    values += [rng.uniform(-1000, 1000) for _ in range(3000)]
    values += [rng.randrange(0, 10**5) / 1000 for _ in range(3000)]
    assert column(spark, values, "double", text.round2(F.col("v"))) == [round(v, 2) for v in values]
    assert column(spark, values, "double", text.two_decimals(F.col("v"))) == [f"{v:.2f}" for v in values]


def test_one_decimal(spark):
    values = [n / 1024 for n in range(0, 5000, 7)] + [0.25, 0.75, 115.25]
    assert column(spark, values, "double", text.one_decimal(F.col("v"))) == [f"{v:.1f}" for v in values]


def test_title(spark):
    values = ["sql_injection", "sql2x", "they're", "XSS", "a-b c", "éa b", "", "_x__y"]
    assert column(spark, values, "string", text.title(F.col("v"))) == [v.title() for v in values]


def test_strip_and_blank(spark):
    values = ["  a b ", "\t\n", "", "\x1c\x1d x\x1e", "  y　", "z"]
    assert column(spark, values, "string", text.strip(F.col("v"))) == [v.strip() for v in values]
    assert column(spark, values, "string", text.is_blank(F.col("v"))) == [not v.strip() for v in values]


def test_decode_drops_invalid_bytes_and_keeps_the_genuine_mark(spark):
    raw = [b"a\xff\xfeb", b"a\r\nb\rc", b"", "é�".encode(), b"\xf0\x9fA", "x𝄞".encode(), b"\xc3", b"\xed\xa0\x80z"]
    wanted = [b.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n") for b in raw]
    assert column(spark, raw, "binary", text.decode_utf8(F.col("v"))) == wanted


@pytest.mark.parametrize(
    ("url", "valid", "name"),
    [
        ("https://h/o/r.git", True, "o_r"),
        ("https://h/a/o/r/", True, "o_r"),
        ("https://h/x", True, "unknown_repo"),
        ("https://h", True, "unknown_repo"),
        ("ftp://h/o/r", False, "o_r"),
        ("HTTPS://h/o/r", True, "o_r"),
        ("https:///o/r", False, "o_r"),
        ("https://h/o/r.git.git", True, "o_r.git"),
        ("https://h/o/r?x=1#y", True, "o_r"),
        ("", False, "unknown_repo"),
    ],
)
def test_urls(spark, url, valid, name):
    assert column(spark, [url], "string", urls.is_valid_url(F.col("v"))) == [valid]
    assert column(spark, [url], "string", urls.repo_name(F.col("v"))) == [name]


def test_null_url_is_invalid(spark):
    assert column(spark, [None], "string", urls.is_valid_url(F.col("v"))) == [False]


def test_confidence_floor(spark):
    rows = [("critical", None, 0.9), ("HIGH", None, 0.8), (None, None, 0.7), ("odd", None, 0.5),
            ("high", "llm_analysis", 0.8), ("medium", "static_analysis", 0.8), ("low", "pattern_matching", 0.55), ("low", "other", 0.5)]
    table = spark.createDataFrame(rows, "s string, m string, want double")
    bad = table.where(F.abs(scores.confidence_floor(F.col("s"), F.col("m")) - F.col("want")) > 1e-12)
    assert bad.count() == 0


def test_bands_and_levels(spark):
    values = [29.99, 30.0, 49.999, 50.0, 69.9, 70.0]
    assert column(spark, values, "double", scores.risk_band(F.col("v"))) == ["Low", "Medium", "Medium", "High", "High", "Critical"]
    rows = spark.createDataFrame([(7.0, 0, 0), (6.9, 10, 0), (0.0, 0, 20), (4.0, 0, 0), (0.0, 5, 0), (0.0, 0, 10), (3.9, 4, 9)], "m double, d int, h int")
    got = [r[0] for r in rows.select(scores.static_risk_level(F.col("m"), F.col("d"), F.col("h"))).collect()]
    assert got == ["high"] * 3 + ["medium"] * 3 + ["low"]


def test_run_status(spark):
    rows = spark.createDataFrame([(3, 0, None), (3, 1, None), (1, 1, None), (0, 1, None), (3, 0, "timeout"), (3, 0, "boom")], "e int, f int, a string")
    got = [r[0] for r in rows.select(scores.run_status(F.col("e"), F.col("f"), F.col("a"))).collect()]
    assert got == ["success", "partial_success", "failure", "failure", "timeout", "failure"]


def test_rounding_of_large_values(spark):
    values = [1e13 + 0.125, 1e13 + 0.126953125, 3.3e13 + 0.37890625, -1e13 - 0.625, 2.0**52 + 0.5, 2.0**53 + 2, 9e15, 1e300]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(text.round2(F.col("v"))).collect()
    assert [r[0] for r in got] == [round(v, 2) for v in values]


def test_doubles_as_python_prints_them(spark):
    values = [0.0, -0.0, 1.0, -2.5, 0.001, 0.00012, -0.0001, 2.9e-05, 1e-10, 2.5e-300, 1e7, 12345678.9, -123456789012.5, 1e15, 1.5e15, 1e16, 1e100, -3e-120]
    values += [float(f"{random.Random(e).uniform(1, 10):.6f}e{e}") for e in range(-12, 20)]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", text.double_text(F.col("v"))).collect()
    assert [r[1] for r in sorted(got)] == [repr(v) for v in values]
    odd = spark.createDataFrame([(float("inf"),), (float("nan"),), (None,)], "v double").select(text.double_text(F.col("v"))).collect()
    assert [r[0] for r in odd] == ["Infinity", "NaN", None]
