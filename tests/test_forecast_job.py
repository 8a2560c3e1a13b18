"""One model, added to the store: selections, known-future inputs, scoring later."""

from __future__ import annotations

import tempfile

import pytest
from conftest import day, put

from tidecast import fixed
from tidecast.operators import accuracy as A
from tidecast.plans.forecast_job import forecast_lines
from tidecast.sources import exports
from tidecast.sources.store import Store


def _body(n):
    out = "Day,Campaign,Budget,Cost,Clicks\n"
    for i in range(n):
        out += f"{day(i)},Brand,{10 + i % 5},{3 * (10 + i % 5)},{i % 9}\n"
        out += f"{day(i)},Sale,{20 + i % 3},{2 * (20 + i % 3)},{i % 4}\n"
    return out


def _lines(spark, n):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    put(folder, "acme.csv", _body(n))
    return exports.read_lines(spark, folder)


@pytest.fixture(scope="module")
def store(spark):
    return Store(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/store").create()


def test_runs_accumulate_and_are_scored(spark, store):
    first = forecast_lines(_lines(spark, 60), store, "seasonal_naive", horizon=7)
    assert first.violations.count() == 0
    assert [r["model"] for r in store.read("runs").collect()] == ["seasonal_naive"]
    assert store.accuracy_view().where("actual is not null").count() == 0
    forecast_lines(_lines(spark, 64), store, "trend_weekday", columns=["cost"])
    runs = {r["model"]: r for r in store.read("runs").collect()}
    assert runs["trend_weekday"]["metrics"] == ["Cost"]
    view = store.accuracy_view()
    assert spark.sql("select count(*) from forecast_accuracy where actual is not null").first()[0]
    assert A.summary(A.select_scores(view, metric="Cost")).first()["n_days"] == 4
    assert A.waiting_and_leaked(A.select_scores(view, metric="Clicks")).first()["waiting"] == 3


def test_known_future(spark, store):
    coming = [10.0, 14.0, 12.0]
    done = forecast_lines(
        _lines(spark, 60), store, "covariate_line", horizon=3, entities=["Brand"],
        future={"Budget": coming})
    rows = done.flight.where("metric = 'Cost'").orderBy("day").collect()
    assert [r["entity"] for r in rows] == ["Brand"] * 3
    assert [round(r["q"][4], 6) for r in rows] == [3 * v for v in coming]
    assert done.flight.where("metric = 'Budget'").count() == 0


def test_own_model_with_inputs(spark, store):
    class Echo:
        name, quantiles, covariates = "echo", fixed.GRID, True

        def forecast(self, past, horizon, metrics, future=None):
            assert "Budget" in past.columns and len(future) == horizon
            return {m: [[v] * 9 for v in future["Budget"]] for m in metrics}

    done = forecast_lines(_lines(spark, 40), store, Echo(), 2, future={"Budget": [5.0, 6.0]})
    rows = done.flight.where("metric = 'Clicks' and entity = '(account)'").orderBy("day")
    assert [r["q"][0] for r in rows.collect()] == [5.0, 6.0]


def test_refusals(spark, store):
    lines = _lines(spark, 40)
    with pytest.raises(ValueError, match="cannot use"):
        forecast_lines(lines, store, "seasonal_naive", future={"Budget": [1.0] * 7})
    with pytest.raises(ValueError, match="horizon"):
        forecast_lines(lines, store, "covariate_line", future={"Budget": [1.0]})
    with pytest.raises(ValueError, match="at least 1"):
        forecast_lines(lines, store, horizon=0)
    done = forecast_lines(lines, store, entities=["Nobody"], columns=["Cost", "Budget", "Nope"])
    got = {(r["rule"], r["entity"] or r["column_name"], r["detail"])
           for r in done.violations.collect()}
    assert got == {("entity_not_forecast", "Nobody", "unknown"),
                   ("column_not_forecastable", "Budget", "setting"),
                   ("column_not_forecastable", "Nope", "unknown")}
    assert done.flight.count() == 0
