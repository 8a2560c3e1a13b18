"""Forecasters, the contract their output must meet, windows and averages."""

from __future__ import annotations

import datetime as dt
import math
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidecast import fixed
from tidecast.operators import forecast as M
from tidecast.operators import panel as P
from tidecast.operators import quality as Q

START = dt.date(2026, 1, 1)
N = 140
SHAPES = {
    "ramp": lambda i: 100.0 + 6 * i,
    "flat": lambda i: 500.0,
    "wave": lambda i: 800.0 + 250 * math.sin(2 * math.pi * i / 7),
}


def _history(spark, shapes=SHAPES, n=N, window="full"):
    end = START + dt.timedelta(days=n - 1)
    rows = [
        ("s", "(account)", m, None, window, end, START + dt.timedelta(days=i), float(f(i)))
        for m, f in shapes.items()
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows, "series_id string, entity string, metric string, concept string, window string, "
        "as_of date, day date, value double")


def _medians(flight):
    out = {}
    for r in sorted(flight.collect(), key=lambda r: r["day"]):
        out.setdefault(r["metric"], []).append(r["q"][4])
    return out


@pytest.mark.parametrize("name", sorted(M.NATIVE) + ["pooled_ridge"])
def test_shapes(spark, name):
    history = _history(spark)
    make = M.NATIVE.get(name, M.pooled_ridge)
    flight = make(history, 10)
    got = _medians(flight)
    assert {m: len(v) for m, v in got.items()} == {m: 10 for m in SHAPES}
    assert np.allclose(got["flat"], 500, rtol=0.05)
    assert max(got["wave"]) > 900 and min(got["wave"]) < 700
    if name != "weekday_quantile":
        assert np.mean(got["ramp"]) > 100 + 6 * 125
    first = min(r["day"] for r in flight.collect())
    assert first == START + dt.timedelta(days=N)


@pytest.mark.parametrize("name", sorted(M.NATIVE))
def test_one_metric_moves_only_itself(spark, name):
    base = _medians(M.NATIVE[name](_history(spark), 7))
    changed = dict(SHAPES, ramp=lambda i: 3.0 * i)
    other = _medians(M.NATIVE[name](_history(spark, changed), 7))
    assert other["flat"] == base["flat"] and np.allclose(other["wave"], base["wave"])
    assert not np.allclose(other["ramp"], base["ramp"])


def test_covariate_moves_the_forecast(spark):
    shapes = {"Cost": lambda i: 3.0 * (i % 11) + 5}
    history = _history(spark, shapes)
    past = history.select("series_id", "entity", "day",
                          (F.datediff("day", F.lit(START)) % 11).cast("double").alias("x"))
    days = [("s", "(account)", START + dt.timedelta(days=N + i), float(i)) for i in range(5)]
    future = spark.createDataFrame(days, "series_id string, entity string, day date, x double")
    got = _medians(M.covariate_line(history, past, future))["Cost"]
    assert np.allclose(got, [5 + 3 * i for i in range(5)])


def _last_value(with_inputs):
    class Last:
        name, quantiles, covariates = "last", fixed.GRID, with_inputs

        def forecast(self, past, horizon, metrics, future=None):
            add = future.sum(axis=1).to_numpy() if future is not None else [0.0] * horizon
            return {m: [[past[m].iloc[-1] + a] * 9 for a in add] for m in metrics}

    return Last()


def test_plugin(spark):
    history = _history(spark)
    flight = M.with_plugin(history, _last_value(True), 7)
    assert _medians(flight)["flat"] == [500.0] * 7
    assert M.contract_violations(flight, 7).count() == 0
    rows = [("s", "(account)", "flat", START + dt.timedelta(days=N + i), float(i))
            for i in range(7)]
    future = spark.createDataFrame(
        rows, "series_id string, entity string, metric string, day date, value double")
    got = _medians(M.with_plugin(history, _last_value(True), 7, ["flat"], future))
    assert set(got) == {"ramp", "wave"}
    assert got["ramp"] == [100.0 + 6 * 139 + i for i in range(7)]
    with pytest.raises(ValueError, match="cannot use"):
        M.with_plugin(history, _last_value(False), 7, ["flat"], future)


def test_a_model_is_loaded_once_by_each_worker(spark, folder):
    one = _history(spark)
    many = one.crossJoin(spark.range(40)).withColumn(
        "series_id", F.concat("series_id", F.col("id").cast("string"))).drop("id")

    last = _last_value(False)

    def load():
        import os
        import tempfile

        os.close(tempfile.mkstemp(dir=folder, prefix=f"{os.getpid()}-")[0])
        return last

    model = M.Loaded("last", fixed.GRID, load)
    spread = many.repartition(16, *M.KEYS)
    first = sorted(map(str, M.with_plugin(spread, model, 7).collect()))
    again = sorted(map(str, M.with_plugin(spread, model, 7).collect()))
    assert first == again == sorted(
        map(str, M.with_plugin(spread, last, 7).collect()))
    loads = [name.split("-")[0] for name in os.listdir(folder)]
    assert 0 < len(loads) == len(set(loads)) <= 16 and len(first) == 40 * 3 * 7
    other = M.Loaded("last", fixed.GRID, load)
    M.with_plugin(spread, other, 7).count()
    assert other.key != model.key and len(os.listdir(folder)) > len(loads)


def _flight(spark, days, metric="Cost", n=None):
    rows = [("s", "e", metric, "full", "m", START, START + dt.timedelta(days=1 + i),
             [float(v) for v in q]) for i, q in enumerate(days)]
    return spark.createDataFrame(
        rows, "series_id string, entity string, metric string, window string, model string, "
        "as_of date, day date, q array<double>")


def _problem(spark, days, horizon, nq):
    rows = M.contract_violations(_flight(spark, days), horizon, nq).collect()
    return rows[0]["problem"] if rows else None


def test_contract(spark):
    assert _problem(spark, [[1, 2, 3], [1, 2, 3]], 2, 3) is None
    assert _problem(spark, [[1, 2, 3]], 2, 3) == "days"
    assert _problem(spark, [[1, 2]], 1, 3) == "quantiles"
    assert _problem(spark, [[1, float("nan"), 3]], 1, 3) == "not finite"
    assert _problem(spark, [[1, float("inf"), 3]], 1, 3) == "not finite"
    assert _problem(spark, [[100, 50, 120]], 1, 3) == "out of order"
    assert _problem(spark, [[100, 99.8, 120]], 1, 3) is None
    assert _problem(spark, [[2e-9, 1e-9, 3e-9]], 1, 3) is None
    assert _problem(spark, [[-100, -150, 20]], 1, 3) == "out of order"


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.floats(-1e6, 1e6), min_size=9, max_size=9), min_size=1, max_size=8))
def test_repair_sorts_and_keeps_every_value(spark, days):
    flight = _flight(spark, days)
    got = [r["q"] for r in M.repaired(flight).orderBy("day").collect()]
    assert got == [sorted(d) for d in days]
    floor = [r["q"] for r in M.floored(M.repaired(flight)).orderBy("day").collect()]
    assert floor == [[max(0.0, v) for v in sorted(d)] for d in days]


def test_floor_by_metric(spark):
    for metric, floored in [("Cost", True), ("Impr.", True), ("Clicks", True), ("CPA", True),
                            ("Revenue", False), ("CTR", False), ("Cost / conv.", False),
                            ("Mystery", False)]:
        row = M.floored(_flight(spark, [[-2, -1, 3]], metric)).first()
        assert (row["q"][0] == 0) is floored and row["clamped"] == (2 if floored else 0), metric


def test_windows_by_length(spark):
    rows = [(f"{n}", n, START, START + dt.timedelta(days=n - 1)) for n in (32, 90, 91, 270, 300)]
    stats = spark.createDataFrame(rows, "source string, n_days long, first_day date, last_day date")
    got = {}
    for r in P.window_plan(stats).collect():
        got.setdefault(r["source"], set()).add(r["window"])
    assert got == {"32": {"full"}, "90": {"full"}, "91": {"full", "90d"},
                   "270": {"full", "90d"}, "300": {"full", "270d", "90d"}}


def test_average(spark):
    def run(model, window, base, n=3):
        return _flight(spark, [[base + i for i in range(n)]]).withColumn(
            "model", F.lit(model)).withColumn("window", F.lit(window))

    both = run("a", "90d", 1).unionByName(run("b", "90d", 3)).unionByName(run("a", "full", 100))
    avg = M.average_runs(M.averaged_members(both), quantiles=[0.1, 0.5, 0.9]).collect()
    assert [r["q"] for r in avg] == [[2.0, 3.0, 4.0]] and avg[0]["n_runs"] == 2
    only_full = run("a", "full", 1).unionByName(run("b", "full", 3))
    assert M.average_runs(M.averaged_members(only_full), quantiles=[0.1, 0.5, 0.9]).count() == 1
    odd_grid = run("a", "90d", 1).unionByName(run("b", "90d", 3, n=5))
    assert M.average_runs(odd_grid, quantiles=[0.1, 0.5, 0.9]).count() == 0
    fitted = run("a", "90d", 1).unionByName(run("ft", "90d", 3))
    assert M.average_runs(M.averaged_members(fitted, ["ft"]), quantiles=[0.1, 0.5, 0.9]).count() == 0


def test_fingerprint(spark):
    one = M.series_hash(_history(spark)).first()["input_hash"]
    again = M.series_hash(_history(spark).orderBy(F.rand(1))).first()["input_hash"]
    other = M.series_hash(_history(spark, dict(SHAPES, flat=lambda i: 500.0 + (i == 9)))).first()
    assert one == again != other["input_hash"]


def test_future_inputs(spark):
    cols = spark.createDataFrame(
        [("s", "Cost", "metric"), ("s", "Budget", "setting"), ("s", "Note", "text")],
        "source string, name string, role string")

    def details(rows):
        future = spark.createDataFrame(rows, "source string, metric string, step int, value double")
        return {r["detail"] for r in Q.future_inputs(cols, future, 2).collect()}

    assert details([("s", "Budget", 1, 5.0), ("s", "Budget", 2, 5.0)]) == set()
    assert details([("s", "Budget", 1, 5.0)]) == {"length differs from the horizon"}
    assert "not a numeric column" in details([("s", "Note", 1, 5.0), ("s", "Note", 2, 5.0)])
    assert "nothing left to forecast" in details([("s", "Cost", 1, 5.0), ("s", "Cost", 2, 5.0)])
    assert "given twice" in details(
        [("s", "Budget", 1, 5.0), ("s", "Budget", 1, 6.0), ("s", "Budget", 2, 5.0)])
    with pytest.raises(ValueError):
        Q.check_horizon(0)
