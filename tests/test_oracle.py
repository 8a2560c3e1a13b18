"""Registered queries against their SQL on the smallest tables.

``python tests/oracle_check.py`` runs all of them; a cross-section is kept here.
"""

from __future__ import annotations

import json
import re

import pytest
from oracle_check import compare, oracle_connection

import __spark_entry__ as E
from tidecast.operators import report as O
from tidecast.plans import queries as Qs

SF = "/root/testdata/sf0.001"
PICKED = [
    "csv_records", "clean_cells", "parse_dates", "column_profile", "metric_concepts",
    "rate_denominators", "fill_absent", "same_entities", "day_gaps", "account_totals",
    "blended_rates", "trend_weekday", "ensemble_average", "quantile_repair",
    "forecast_contract", "forecast_accuracy", "shared_entities", "drawn_runs", "backtest",
    "closed_days_stream", "store_replace", "published_versions", "repeated_append", "late_events",
    "broken_exports", "group_hints", "first_entities", "fitted_lines",
    "scored_streams",
]


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", PICKED)
def test_query(spark, con, name):
    problems, _ = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF)
    assert not problems


def test_registration():
    assert set(E.oracle_sql()) <= set(E.queries())
    missing = set(E.queries()) - set(E.oracle_sql())
    # What SQL cannot express is among the corpus queries, and tested beside them.
    assert not {n for n in missing if n != "pipeline" and not re.match(r"op\d+_", n)}


def test_entry(spark):
    assert E.entry(spark).count() == 18


def test_chart_payload_against_its_tables(spark):
    lines, _, series = Qs._lines(spark, SF)
    past, ahead = {}, {}
    for r in series.collect():
        past.setdefault((r["series_id"], r["entity"], r["metric"]), []).append((str(r["day"]), r["value"]))
    for r in lines.collect():
        key = (r["series_id"], r["entity"], r["metric"])
        ahead.setdefault(key, {}).setdefault(r["model"], []).append((str(r["day"]), r["median"]))
    rows = O.chart_payload(series, lines).collect()
    assert len(rows) == len(past) == len(ahead)
    for r in rows:
        key = (r["series_id"], r["entity"], r["metric"])
        doc = json.loads(r["payload"])
        want = sorted(past[key])
        assert doc["days"] == [d for d, _ in want] and doc["cut"] == len(want)
        assert doc["actual"] == pytest.approx([v for _, v in want])
        for line in doc["lines"]:
            want_line = sorted(ahead[key][line["model"]])
            assert [p["day"] for p in line["points"]] == [d for d, _ in want_line]
            assert [p["median"] for p in line["points"]] == pytest.approx(
                [v for _, v in want_line])
