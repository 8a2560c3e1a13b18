"""Reading single cells and dates."""

from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidecast.functions import cells as C

NUMBERS = [
    ("12", 12.0), ("1,234.56", 1234.56), ("1.234,56", 1234.56), ("1.234.567,89", 1234567.89),
    ("1,234,567.89", 1234567.89), ("1,200", 1200.0), ("1234,56", 1234.56), ("0,5", 0.5),
    ("100.5", 100.5), ("£300", 300.0), ("(1.234,56)", -1234.56), ("4.20%", 4.2), ("-5", -5.0),
    ("+7", 7.0), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0), ("1 234", 1234.0),
    ("1 234,5", 1234.5), ("(5%)", -5.0), ("₹ 12", 12.0), ("$", 0.0), ("", 0.0), (" ", 0.0),
    ("-", 0.0), ("--", 0.0), ("---", 0.0), ("–", 0.0), ("—", 0.0), ("N/A", 0.0), ("n/a", 0.0),
    ("NA", 0.0), ("NaN", 0.0), ("null", 0.0), ("NULL", 0.0), ("none", 0.0), ("nil", 0.0),
    ("abc", None), ("12abc", None), ("Enabled", None), ("1.2.3", None), ("Inf", None),
    ("Infinity", None), ("-Inf", None), ("0x1p4", None), ("0X10", None), ("1_000", None),
    ("1e400", None), ("1d", None), ("1f", None), ("1,2,3", None),
]


def test_numbers(spark):
    df = spark.createDataFrame([(s,) for s, _ in NUMBERS], "cell string")
    got = {r["cell"]: r["v"] for r in df.select("cell", C.number(F.col("cell")).alias("v")).collect()}
    for cell, want in NUMBERS:
        if want is None:
            assert got[cell] is None, cell
        else:
            assert got[cell] is not None and math.isclose(got[cell], want, abs_tol=1e-9), cell


def test_stepwise_reader_says_the_same(spark):
    df = spark.createDataFrame([(s,) for s, _ in NUMBERS] + [("7%",), ("(7%)",)], "cell string")
    c = F.col("cell")
    rows = C.with_numbers(df, {"v": c}).select(
        "v", C.number(c).alias("n"), "v_percent", C.is_percent(c).alias("p"),
        "v_no_data", C.is_no_data(c).alias("d"),
    ).collect()
    for r in rows:
        assert (r["v"], r["v_percent"], r["v_no_data"]) == (r["n"], r["p"], r["d"])


DAYS = [
    ("2026-01-31", "2026-01-31", None, None), ("2026/01/31", "2026-01-31", None, None),
    ("2026-01-31 23:59:59", "2026-01-31", None, None),
    ("2026-01-31T23:30:00Z", "2026-01-31", None, None),
    ("2026-01-31T23:30:00+05:30", "2026-01-31", None, None),
    ("3 Jan 2026", "2026-01-03", None, None), ("03 jan 2026", "2026-01-03", None, None),
    ("Dec 31, 2025", "2025-12-31", None, None), ("2024-02-29", "2024-02-29", None, None),
    ("2026-02-29", None, None, None), ("2026-1-3", None, None, None),
    ("31/01/2026", None, "2026-01-31", None), ("01/31/2026", None, None, "2026-01-31"),
    ("01.02.2026", None, "2026-02-01", "2026-01-02"),
    ("01-02-2026", None, "2026-02-01", "2026-01-02"), ("01/02-2026", None, None, None),
    ("Brand Search", None, None, None), ("100", None, None, None), ("", None, None, None),
    ("2026-01-31 24:00:00", None, None, None), ("2026-13-01", None, None, None),
]


def test_days(spark):
    df = spark.createDataFrame([(d[0],) for d in DAYS], "cell string")
    c = F.col("cell")
    got = {
        r["cell"]: tuple(str(x) if x else None for x in (r["p"], r["d"], r["m"]))
        for r in df.select(
            "cell", C.plain_day(c).alias("p"), C.day_first(c).alias("d"),
            C.month_first(c).alias("m"),
        ).collect()
    }
    for cell, *want in DAYS:
        assert got[cell] == tuple(want), cell


@pytest.mark.parametrize("text", ["a\x01b", "\x1b[2Kx", "tab\there", "\x7f"])
def test_controls_go(spark, text):
    got = spark.createDataFrame([(text,)], "c string").select(
        C.without_controls(F.col("c"))
    ).first()[0]
    assert got == "".join(ch for ch in text if ord(ch) >= 32 and ord(ch) != 127)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-1e9, 1e9).map(lambda x: round(x, 2)), min_size=1, max_size=50))
def test_any_spelling_of_a_number_reads_back(spark, values):
    spelled = []
    for v in values:
        us = f"{abs(v):,.2f}"
        eu = us.translate(str.maketrans(",.", ".,"))
        sign = "-" if v < 0 else ""
        spelled += [(sign + us, v), (sign + eu, v), (f"({us})", -abs(v)), (f"{sign}{us} %", v)]
    df = spark.createDataFrame(spelled, "cell string, want double")
    bad = df.where(~(F.abs(C.number(F.col("cell")) - F.col("want")) < 1e-6)).collect()
    assert not bad
