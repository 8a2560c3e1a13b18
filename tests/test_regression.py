from __future__ import annotations

import math
import random

import numpy as np
import pytest
from test_forecast import _history, _medians

from tidecast.operators import forecast as M
from tidecast.operators import regression as G


def _rows(width, n=200, seed=1):
    r = random.Random(seed)
    rows = []
    for g in "ab":
        for _ in range(n):
            x = [r.gauss(i, 1 + i) for i in range(width)]
            rows.append((g, x, sum((i + 1) * v for i, v in enumerate(x)) + r.gauss(5, 1)))
    return rows


def _wanted(rows, reg):
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    d = x - x.mean(0)
    c = d.T @ d / len(y)
    return np.linalg.lstsq(c + reg * np.diag(np.diag(c)), d.T @ (y - y.mean()) / len(y), rcond=None)[0]


def _fit(spark, rows, width, reg):
    df = spark.createDataFrame(rows, "g string, x array<double>, y double")
    found = G.fitted(G.moments(df, ["g"], width), width, reg)
    return {r["g"]: r for r in found.collect()}


@pytest.mark.parametrize(("width", "reg"), [(1, 0.0), (3, 0.1), (8, 0.0), (12, 0.1)])
def test_any_width(spark, width, reg):
    rows = _rows(width)
    got = _fit(spark, rows, width, reg)
    for g in "ab":
        assert np.allclose(got[g]["b"], _wanted([r for r in rows if r[0] == g], reg))


def test_constant_and_collinear_inputs_leave_the_rest_alone(spark):
    rows = [(g, [*x, 7.0, 2 * x[0] - x[1] + 1], y) for g, x, y in _rows(3)]
    got = _fit(spark, rows, 5, 0.0)
    for g in "ab":
        own = [r for r in rows if r[0] == g]
        assert got[g]["b"][3:] == [0.0, 0.0]
        assert np.allclose(got[g]["b"][:3], _wanted([(g, x[:3], y) for _, x, y in own], 0.0))
    shared = _fit(spark, rows, 5, 0.1)["a"]["b"]
    assert shared[3] == 0.0 and np.allclose(shared, _wanted(rows[:200], 0.1))


def test_sums_of_later_days_are_added(spark):
    rows = _rows(3)
    df = spark.createDataFrame(rows, "g string, x array<double>, y double")
    early, late = df.where("y < 10"), df.where("y >= 10")
    both = G.added(G.moments(early, ["g"], 3), G.moments(late, ["g"], 3), ["g"], 3)
    for r in G.fitted(both, 3).collect():
        assert np.allclose(r["b"], _wanted([x for x in rows if x[0] == r["g"]], 0.0))


def test_unusable_rows_and_no_rows(spark):
    rows = _rows(2)
    bad = [("a", None, 1.0), ("a", [1.0, None], 1.0), ("a", [1.0, math.nan], 1.0), ("a", [1.0], 2.0),
           ("a", [1.0, math.inf], 1.0), ("a", [1.0, 2.0], None), ("a", [1.0, 2.0], math.nan)]
    assert _fit(spark, rows + bad, 2, 0.1) == _fit(spark, rows, 2, 0.1)
    assert _fit(spark, bad, 2, 0.1) == {}
    assert _fit(spark, [("a", [1.0, 2.0], 3.0)], 2, 0.0)["a"]["b"] == [0.0, 0.0]


def test_wider_lags_follow_a_longer_cycle(spark):
    """A cycle of four weeks: two weeks back do not show it, four do."""
    shapes = {"month": lambda i: 1000.0 + 300 * (i // 7 % 4) + 5 * (i * 7 % 13)}
    history = _history(spark, shapes)
    true = [shapes["month"](len(history.collect()) + i) for i in range(10)]
    near = _medians(M.pooled_ridge(history, 10))["month"]
    wide = _medians(M.pooled_ridge(history, 10, lags=[1, 2, 3, 4], means=[7, 28]))["month"]
    miss = [float(np.mean(np.abs(np.array(v) - true))) for v in (near, wide)]
    assert miss[1] < 100 and miss[1] < miss[0] / 2


def test_settings():
    assert M.ridge_settings(lags=[1, 4]) == {"lags": [1, 4], "means": [28], "reg": 0.1}
    for wrong in ({"lag": [1]}, {"lags": [], "means": []}, {"lags": [0]}):
        with pytest.raises(ValueError):
            M.ridge_settings(**wrong)
