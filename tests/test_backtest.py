"""Walk-forward over arrays against the same forecasters run on copies of the history."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from tidecast.operators import backtest as B
from tidecast.operators import forecast as M
from tidecast.sources.tables import panel_stats

START = dt.date(2026, 1, 1)


def _panel(spark):
    rng = random.Random(1)
    rows = []
    for source, entity, first, n in (("a", "x", 0, 70), ("a", "late", 30, 40), ("a", "stopped", 0, 45),
                                     ("b", "y", 5, 26), ("c", "short", 0, 6)):
        for metric in ("Cost", "Clicks"):
            rows += [(source, entity, metric, None, START + dt.timedelta(days=first + i),
                      rng.choice([0.0, round(rng.uniform(1, 100), 2)])) for i in range(n)]
    return spark.createDataFrame(
        rows, "source string, entity string, metric string, concept string, day date, value double")


@pytest.mark.parametrize("options", [
    {}, {"step": 3, "horizon": 10}, {"windows": [("full", 0), ("20d", 20), ("5d", 5)], "step": 2},
    {"n_origins": 2}])
def test_same_as_copies(spark, options):
    panel = _panel(spark)
    old = B.backtest(panel, panel_stats(panel), [M.seasonal_naive, M.weekday_quantile], **options)
    new = B.walk_forward(panel, panel_stats(panel), **options)
    names = ["series_id", "entity", "metric", "model", "window", "origin", "days_ahead", "day",
             "forecast", "actual", "low", "high"]

    def rows(df):
        return sorted(tuple(str(None if v is None else round(v, 7) if isinstance(v, float) else v)
                            for v in r) for r in df.select(*names).collect())

    got, want = rows(new), rows(old)
    assert len(got) > 100 and got == want


def test_days_that_are_missing_are_unknown(spark):
    panel = _panel(spark).where("source = 'a' AND entity = 'x' AND metric = 'Cost'")
    holes = panel.where("day NOT IN (DATE '2026-02-03', DATE '2026-03-04')")
    got = B.walk_forward(holes, panel_stats(panel), models=("weekday_quantile",)).collect()
    assert all(str(r["day"]) not in ("2026-02-03", "2026-03-04") for r in got)
    whole = B.walk_forward(panel, panel_stats(panel), models=("weekday_quantile",)).count()
    assert 0 < len(got) < whole
    assert B.walk_forward(panel.limit(0), panel_stats(panel.limit(0))).collect() == []
