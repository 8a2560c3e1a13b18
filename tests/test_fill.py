"""Exports that list an entity only on the days it ran."""

from __future__ import annotations

import tempfile

import pytest
from conftest import day, put

from tidecast.operators import quality as Q
from tidecast.plans.import_job import read_batch
from tidecast.sources import exports
from tidecast.sources.store import raw_rows


@pytest.fixture(scope="module")
def batch(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    ragged = "Day,Campaign,Last seen,Cost,Clicks,Campaign ID\n"
    rates = "Day,Campaign,Cost per thing\n"
    hole = "Day,Campaign,Cost\n"
    renamed = "Day,Campaign,Cost\n"
    for i in range(120):
        ragged += f"{day(i)},Live,{day(i)},{100 + i},{i % 7},1\n"
        if i < 40:
            ragged += f"{day(i)},Gone,{day(i)},{50 + i},{i % 3},2\n"
        if i >= 30:
            ragged += f"{day(i)},New,{day(i)},{20 + i},{i % 5},3\n"
        hole += f"{day(i)},A,{i}\n" + (f"{day(i)},B,{i}\n" if i != 50 else "")
        renamed += f"{day(i)},{'Summer' if i < 60 else 'Autumn'},{i}\n{day(i)},Brand,{i * 2}\n"
    for i in range(40):
        rates += f"{day(i)},A,10\n{day(i)},B,20\n" + (f"{day(i)},C,30\n" if i >= 20 else "")
    for name, body in (("ragged", ragged), ("rates", rates), ("hole", hole),
                       ("renamed", renamed), ("nolabel", "Day,Cost\n" + "".join(
                           f"{day(i)},{i}\n" for i in range(40)))):
        put(folder, f"{name}.csv", body)
    return read_batch(exports.read_lines(spark, folder), fill_absent=True)


def test_refusals(batch):
    got = {r["source"]: r["rule"] for r in Q.first_violation(batch.violations).collect()}
    assert got == {"hole": "interior_hole", "nolabel": "no_fill_label"}
    holes = batch.violations.where("rule = 'interior_hole'").collect()
    assert [(r["entity"], str(r["day"])) for r in holes] == [("B", day(50))]


def test_states(batch):
    got = {(r["source"], r["entity"]): r["state"] for r in batch.states.collect()}
    assert got["ragged", "Gone"] == "stopped"
    assert got["ragged", "Live"] == got["ragged", "New"] == "live"
    assert got["renamed", "Summer"] == "stopped" and got["renamed", "Autumn"] == "live"


def test_filled_values(batch):
    panel = {(r["source"], r["entity"], r["metric"], str(r["day"])): r["value"]
             for r in batch.panel.collect()}
    assert panel["ragged", "Gone", "Cost", day(100)] == 0
    assert panel["ragged", "New", "Cost", day(0)] == 0
    assert panel["ragged", "(account)", "Cost", day(100)] == 200 + 120
    assert panel["rates", "(account)", "Cost per thing", day(0)] == pytest.approx(15)
    assert panel["rates", "(account)", "Cost per thing", day(39)] == pytest.approx(20)


def test_filled_rows_keep_labels_and_follow_the_day(batch):
    filled = batch.rows.where("filled and source = 'ragged'").collect()
    assert len(filled) == 80 + 30
    for r in filled:
        cells = r["cells"]
        assert cells[0] == cells[2] == str(r["day"])
        assert cells[3] == cells[4] == "0"
        assert cells[5] in ("2", "3") and cells[1] in ("Gone", "New")


def test_filled_rows_never_reach_raw(batch):
    raw = raw_rows(batch.rows, batch.headers).where("source = 'ragged'")
    assert raw.count() == 120 + 40 + 90
    assert raw.where("row_num < 0").count() == 0


def test_raw_rows_with_repeated_names(spark):
    """The later of two equal names is kept, in full rows, short ones and longer ones."""
    headers = spark.createDataFrame(
        [("a", ["Day", "x", "y", "x", "", "column5"]), ("b", None)],
        "source string, header array<string>")
    cells = [("a", 1, ["d", "1", "2", "3", "4", "5"]), ("a", 2, ["d", "1", "2"]),
             ("a", 3, ["d", "1", "2", "3", "4", "5", "6"]), ("a", 4, []), ("b", 1, ["d", "1", "2"]),
             ("c", 1, ["d", None])]
    rows = spark.createDataFrame(cells, "source string, row_num long, cells array<string>").selectExpr(
        "*", "date'2026-01-01' as day", "false as filled")
    got = {(r["source"], r["row_num"]): r["data"] for r in raw_rows(rows, headers).collect()}
    assert got == {
        ("a", 1): {"Day": "d", "y": "2", "x": "3", "column5": "5"},
        ("a", 2): {"Day": "d", "x": "1", "y": "2"},
        ("a", 3): {"Day": "d", "y": "2", "x": "3", "column5": "5", "column7": "6"},
        ("a", 4): {},
        ("b", 1): {"column1": "d", "value": "1", "column3": "2"},
        ("c", 1): {"column1": "d", "value": None},
    }
