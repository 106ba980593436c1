"""Scalar functions: hand-written cases (FIXTURES §4) with expected values."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import (clean_key, clean_number, count_label, growth_label,
                               is_suppressed, marked_segment, money_label, norm_header,
                               or_dash, pct_label, period_end, period_key, segment_family,
                               segment_line, segment_wind_only, short_name, short_segment)


def one_col(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


CLEAN_CASES = [
    (".", None, True), (" . ", None, True), ("0", 0.0, False), (None, None, False),
    ("", None, False), ("-", None, False), ("$3,098,225,107,375", 3098225107375.0, False),
    ("1 234.5", 1234.5, False), ("1 234.5", 1234.5, False), ("(12)", None, False),
    ("12%", None, False), ("abc", None, False), ("1.0d", None, False), ("nan", None, False),
    ("1_000", None, False), ("inf", None, False), ("1e5", 100000.0, False), ("+5", 5.0, False),
    (".5", 0.5, False), ("5.", 5.0, False), ("-12.25", -12.25, False), ("$-1,000", -1000.0, False),
]


def test_clean_number_and_suppression(spark):
    df = spark.createDataFrame([(c[0],) for c in CLEAN_CASES], "raw string")
    got = df.select(clean_number(F.col("raw"), F.lit("s")).alias("v"),
                    is_suppressed(F.col("raw")).alias("s")).collect()
    for (raw, v, s), row in zip(CLEAN_CASES, got):
        assert row.v == v, raw
        assert row.s == s, raw


def test_clean_number_cell_kinds(spark):
    df = spark.createDataFrame([("12", "n"), ("1.5E3", "n"), ("TRUE", "b"), ("FALSE", "b"),
                                ("2024-01-01T00:00:00", "d")], "raw string, kind string")
    got = [r[0] for r in df.select(clean_number(F.col("raw"), F.col("kind"))).collect()]
    assert got == [12.0, 1500.0, 1.0, 0.0, None]


def test_norm_header(spark):
    vals = ["Company Name", "COMPANY\nNAME", "  company   name ", None,
            "Total Number of\r\nPolicies in Force (as of 6/30/2024)"]
    got = one_col(spark, vals, norm_header)
    assert got[:3] == ["company name"] * 3
    assert got[3] == ""
    assert got[4] == "total number of policies in force (as of 6/30/2024)"


def test_clean_key(spark):
    assert one_col(spark, ["00123", " 10064 ", " 10064\t", None], clean_key) == [
        "00123", "10064", "10064", ""]


def test_segment_functions(spark):
    vals = ["PERSONAL residential - X - wind only", "Surety",
            "Commercial Residential - SMALL - WIND ONLY", " personal residential - HO3"]
    assert one_col(spark, vals, segment_line) == [
        "Personal Residential", "Other", "Commercial Residential", "Personal Residential"]
    assert one_col(spark, vals, segment_wind_only) == [True, False, True, False]
    assert one_col(spark, vals, segment_family) == ["X", "Surety", "SMALL", "HO3"]


def test_period_functions(spark):
    df = spark.createDataFrame([("2024Q2",), ("1999Q4",)], "p string")
    rows = df.select(period_key(F.col("p")), period_end(F.col("p"))).collect()
    assert [r[0] for r in rows] == [20242, 19994]
    assert [str(r[1]) for r in rows] == ["2024-06-30", "1999-12-31"]


@pytest.mark.parametrize("v,label", [
    (3098225107375.0, "$3.1T"), (1234567.0, "$1.23M"), (1500.0, "$1.5K"), (999.4, "$999"),
    (1000.0, "$1K"), (2500000000.0, "$2.5B"), (-1234567.0, "$-1.23M"), (0.125e6, "$125K"),
    (1005.0, "$1.01K"), (None, None)])
def test_money_label(spark, v, label):
    assert one_col(spark, [v], money_label, "double") == [label]


def test_money_label_fixed_scale(spark):
    got = one_col(spark, [1234567.0], lambda c: money_label(c, 1000), "double")
    assert got == ["$1,234.57K"]


def test_pct_growth_count_labels(spark):
    assert one_col(spark, [0.1234, 0.00049, None], lambda c: or_dash(pct_label(c)), "double") == [
        "12.3%", "0.0%", "—"]
    assert one_col(spark, [12.34, -150.0, 0.0, None], growth_label, "double") == [
        "+12.3%", "-150.0%", "+0.0%", None]
    assert one_col(spark, [12.345, 0.99999], pct_label, "double") == ["1234.5%", "100.0%"]
    assert one_col(spark, [1234.56, -123456.0], growth_label, "double") == ["+1234.6%", "-123456.0%"]
    assert one_col(spark, [2.5, -2.5, 1234567.4], count_label, "double") == [
        "3", "-2", "1,234,567"]


def test_short_forms(spark):
    long = "A" * 40
    assert one_col(spark, [long, "Short"], short_name) == ["A" * 32 + "…", "Short"]
    assert one_col(spark, ["Commercial Residential - X", "Personal Residential - Y",
                           "Other - Personal Residential - Z"], short_segment) == [
        "C: X", "P: Y", "Other - P: Z"]
    df = spark.createDataFrame([("Personal Residential - Y", True)], "p string, w boolean")
    assert df.select(marked_segment(F.col("p"), F.col("w"))).first()[0] == "〜 P: Y"


def test_exact_sum_keeps_digits_and_never_fails(spark):
    from tessera.functions.numbers import exact_sum, exact_sum0
    groups = {"fine": [0.00004, 0.00004], "huge": [1e40, 1e40], "tiny": [1e-30, 1e-30],
              "money": [0.1] * 10, "null": [None], "mixed": [1e40, 0.25, None],
              "inf": [float("inf"), 1.0], "edge": [9e25] * 3}
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    got = {r.k: (r.s, r.z) for r in spark.createDataFrame(rows, "k string, v double").groupBy("k")
           .agg(exact_sum("v").alias("s"), exact_sum0("v").alias("z")).collect()}
    assert got == {"fine": (0.00008,) * 2, "huge": (2e40,) * 2, "tiny": (2e-30,) * 2,
                   "money": (1.0,) * 2, "null": (None, 0.0), "mixed": (1e40,) * 2,
                   "inf": (float("inf"),) * 2, "edge": (2.7e26,) * 2}


def test_long_integer_keys_sort_as_numbers(spark):
    from tessera.functions.text import naic_sort_keys
    keys = ["9" * 18, "1" + "0" * 18, "2" * 30, "10", "9", "007", "x"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert [r.k for r in df.orderBy(*naic_sort_keys("k")).collect()] == [
        "9", "10", "9" * 18, "1" + "0" * 18, "2" * 30, "007", "x"]
