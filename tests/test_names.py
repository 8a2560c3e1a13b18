"""Reading column names."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecast.functions import names as N
from tidecast.functions import text as X

CONCEPTS = [
    ("Cost", "spend", True), ("Amount spent (USD)", "spend", True), ("Spend", "spend", True),
    ("Impr.", "impressions", True), ("Impressions", "impressions", True),
    ("Video views", "impressions", True), ("Clicks", "clicks", True),
    ("Unique link clicks", "clicks", True), ("Landing page views", "clicks", True),
    ("Purchases", "conversions", True), ("Website purchases", "conversions", True),
    ("Results", "conversions", True), ("Revenue", "revenue", True),
    ("Conversion value", "revenue", True), ("Conv. value", "revenue", True),
    ("Cost per conversion", "cost per", False),
    ("Cost per add to cart (USD)", "cost per", False), ("CPA", "cost per", False),
    ("CPC", "cost per", False), ("Conversion rate", "rate", False), ("CTR", "rate", False),
    ("ROAS", "rate", False), ("Frequency", "rate", False), ("Cost / conv.", "ratio", False),
    ("Conv. value / cost", "ratio", False), ("Purchases (web/app)", "conversions", True),
    ("Coût", None, True), ("Dépense spend", "spend", True), ("Reach", None, True),
    ("Impact", None, True), ("Quality score", None, True), ("Ad relevance", None, True),
    ("Days since launch", None, True), ("Optimisation score", None, True),
    ("Reorder rank", None, True), ("Spend (unbalanced", "spend", True),
]


def test_concepts(spark):
    df = spark.createDataFrame([(n,) for n, _, _ in CONCEPTS], "name string")
    rows = df.select("name", N.concept(F.col("name")).alias("c")).select(
        "name", "c", F.coalesce(N.is_addable(F.col("c")), F.lit(True)).alias("a")
    ).collect()
    got = {r["name"]: (r["c"], r["a"]) for r in rows}
    for name, concept, addable in CONCEPTS:
        assert got[name] == (concept, addable), name


DENOMINATORS = [
    ("CTR", "impressions", ""), ("Avg. CPC", "clicks", ""), ("CPA", "conversions", ""),
    ("ROAS", "spend", ""), ("CPM", "impressions", ""), ("Cost / conv.", "conversions", "conv"),
    ("Conv. value / cost", "spend", "cost"),
    ("Cost per add to cart (USD)", "conversions", "add to cart"),
    ("Cost per thing", None, "thing"), ("Conversion rate", "clicks", ""),
    ("Click-through rate", "impressions", ""), ("Frequency", None, ""),
]


def test_denominators(spark):
    df = spark.createDataFrame([(n,) for n, _, _ in DENOMINATORS], "name string")
    n = F.col("name")
    got = {
        r[0]: (r[1], r[2])
        for r in df.select("name", N.rate_denominator(n), N.denominator_phrase(n)).collect()
    }
    for name, concept, phrase in DENOMINATORS:
        assert got[name] == (concept, phrase), name


def test_identifiers_and_settings(spark):
    names = ["Campaign ID", "Ad group IDs", "Currency code", "Max CPC bid", "Daily budget",
             "campaign_id", "Paid", "Target CPA", "ID", "identity"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    rows = df.select(
        "name", N.is_identifier(F.col("name")).alias("i"), N.is_setting(F.col("name")).alias("s")
    ).collect()
    assert {r["name"] for r in rows if r["i"]} == {
        "Campaign ID", "Ad group IDs", "Currency code", "campaign_id", "ID"
    }
    assert {r["name"] for r in rows if r["s"]} == {"Max CPC bid", "Daily budget", "Target CPA"}


def test_positional_names(spark):
    df = spark.createDataFrame([(" Cost\x01 ", 3), (None, 1), ("  ", 2)], "h string, i int")
    got = [r[0] for r in df.select(N.column_name(F.col("h"), F.col("i"))).collect()]
    assert got == ["Cost", "value", "column3"]


def test_display(spark):
    values = [(0.0, "0"), (-0.0, "0"), (1234.5, "1234.50"), (99.5, "99.500"), (0.5, "0.500000"),
              (1.5e-9, "1.5e-09"), (2e15, "2e+15"), (-12.3456, "-12.346"), (1.3295, "1.329"),
              (1234567.891, "1234567.89"), (-2.5e-7, "-2.5e-07")]
    df = spark.createDataFrame([(v,) for v, _ in values], "v double")
    got = [r[0] for r in df.select(X.display_value(F.col("v"))).collect()]
    assert got == [w for _, w in values]
    pct = spark.createDataFrame([(4.2,)], "v double").select(
        X.display_value(F.col("v"), F.lit(True))
    ).first()[0]
    assert pct == "4.200%"


def test_first_names(spark):
    df = spark.createDataFrame([(list("abc"),), ([str(i) for i in range(20)],)], "n array<string>")
    short, long = [r[0] for r in df.select(X.first_names(F.col("n"))).collect()]
    assert short == ["a", "b", "c"]
    assert len(long) == 13 and long[-1] == "and 8 more"
