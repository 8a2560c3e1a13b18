"""A batch of exports read at once: what is accepted, what is refused and why."""

from __future__ import annotations

import tempfile

import pytest
from conftest import day, put

from tidecast.operators import quality as Q
from tidecast.plans.import_job import read_batch
from tidecast.sources import exports


def _daily(header, rows_of_day, n=40, step=1, order=None):
    days = range(n) if order is None else order
    return header + "\n" + "".join(
        "".join(f"{day(i, step)},{r}\n" for r in rows_of_day(i)) for i in days
    )


def _files():
    """name -> (content, expected first rule or None)"""
    f = {}
    f["good"] = (_daily("date,spend", lambda i: [f"{100 + i}"]), None)
    f["newest_first"] = (
        _daily("date,spend", lambda i: [f"{100 + i}"], order=reversed(range(40))), None)
    f["no_header"] = ("".join(f"{day(i)},{i}\n" for i in range(40)), None)
    f["bom"] = ("﻿" + _daily("date,spend", lambda i: [f"{i}"]), None)
    f["crlf"] = (_daily("date,spend", lambda i: [f"{i}"]).replace("\n", "\r\n"), None)
    f["blank_lines"] = (_daily("date,spend\n", lambda i: [f"{i}\n"]), None)
    f["gap"] = (_daily("date,spend", lambda i: [] if i == 20 else [f"{i}"]), "day_gap")
    f["short"] = (_daily("date,spend", lambda i: [f"{i}"], n=31), "too_short")
    f["weekly"] = (_daily("Day,Cost", lambda i: [f"{100 + i}"], step=7), "segmented")
    f["oops"] = (_daily("Day,Campaign,Impressions,Clicks,Cost",
                        lambda i: [f"Brand {i},{i},{i},{'oops' if i == 3 else i}"]), "bad_cell")
    f["book"] = (b"PK\x03\x04junk", "not_a_csv")
    f["doc"] = (b"%PDF-1.4\njunk", "not_a_csv")
    f["u16"] = (b"\xff\xfeD\x00a\x00y\x00", "not_a_csv")
    f["tabs"] = ("Campaign report\nJan 1 - Dec 31\nDay\tCost\n2026-01-01\t10\n", "not_a_csv")
    f["semi"] = ("Day;Cost\n2026-01-01;10\n", "not_a_csv")
    f["latin"] = ("Day,Coût\n".encode("latin-1")
                  + "".join(f"{day(i)},{i}\n" for i in range(40)).encode(), "header_not_utf8")
    f["title"] = ("My report\nDay,Cost\n" + "".join(f"{day(i)},{i}\n" for i in range(40)),
                  "too_few_columns")
    f["summary"] = ("Campaign,Cost,Clicks\n" + "".join(
        f"Campaign {i},{100 + i},{i}\n" for i in range(40)), "no_dates")
    f["wide"] = ("Day" + ",Cost" * 514 + "\n" + "".join(
        day(i) + ",1" * 514 + "\n" for i in range(3)), "too_large")
    f["ragged"] = (_daily("Day,Cost,Clicks", lambda i: [f"{i},{i}" + (",9" if i == 7 else "")]),
                   "ragged_rows")
    f["quote"] = (_daily("Day,Cost", lambda i: [f'{i}"x' if i == 9 else f"{i}"]), "malformed")
    f["empty"] = ("Day,Cost\n", "no_rows")
    f["dmy"] = ("Day,Cost\n" + "".join(
        f"{day(i)[8:]}/{day(i)[5:7]}/{day(i)[:4]},{i}\n" for i in range(40)), None)
    f["mdy"] = ("Day,Cost\n" + "".join(
        f"{day(i)[5:7]}/{day(i)[8:]}/{day(i)[:4]},{i}\n" for i in range(40)), None)
    f["ambiguous"] = ("Day,Cost\n" + "".join(f"{i:02d}/01/2026,{i}\n" for i in range(1, 13)),
                      "date_order_undecided")
    f["second_column"] = (
        "Cost,Day\n" + "".join(f"{100 + i},{day(i)}\n" for i in range(40)), "unreadable_date")
    f["uneven"] = (_daily("Day,Campaign,Cost", lambda i: [f"A,{i}", f"B,{i * 2}"][: 1 + (i != 5)]),
                   "uneven_days")
    f["twice"] = (_daily("Day,Campaign,Cost", lambda i: [
        f"Brand,{100 + i}", f"{'Brand' if i == 20 else 'Sale'},{60 + i}"]), "entity_twice")
    f["account"] = (_daily("Day,Campaign,Cost", lambda i: [f"Alpha,{i}", f"\x01(account),{i}"]),
                    "named_account")
    f["hidden_twin"] = (_daily("Day,Campaign,Cost", lambda i: [f"Alpha,{i}", f"Alpha\x01,{i}"]),
                        "group_column")
    f["overflow"] = (_daily("Day,Campaign,Cost", lambda i: ["A,1e308", "B,1e308"]), "overflow")
    f["money"] = (_daily("Day,Campaign,Currency code,Cost", lambda i: [
        f"A,USD,{i}", f"B,EUR,{i}"]), "mixed_currency")
    f["same_name"] = (_daily("Day,Cost,cost", lambda i: [f"{i},{i}"]), "same_column_name")
    f["words"] = (_daily("Day,Note", lambda i: [f"note {i}"]), "nothing_to_forecast")
    f["two_groups"] = (_daily("Day,Campaign,Team,Cost", lambda i: [
        f"A,x,{i}", f"B,y,{i}"]), "group_column")
    f["only_measures"] = (_daily("Day,Cost,Clicks", lambda i: ["1,5", "2,6"]), "group_column")
    f["campaigns"] = (_daily(
        "Day,Campaign status,Status,Campaign,Budget,Cost,Impr.,Clicks,Campaign ID",
        lambda i: [
            f"Enabled,Eligible,Brand,50,{100 + i % 7},{1000 + i},{i % 9},11",
            f"Enabled,Eligible,Generic,30,{60 + i % 5},{500 + i},{i % 4},22",
            f"{'Paused' if i >= 60 else 'Enabled'},Eligible (Limited),Zombie,10,{i % 3},{i},{i % 2},33",
        ], n=90), None)
    f["flat"] = (_daily("Day,Campaign,Cost,Impr.,Clicks", lambda i: [
        f"Live,{100 + i},{i},{i}", "Flat,0,0,0"]), None)
    f["rates"] = (_daily("Day,Campaign,Cost,Impr.,Clicks,Conversions,CTR,Avg. CPC,Cost / conv.",
                         lambda i: ["A,300,10000,100,10,1.00,3.00,30.00",
                                    "B,20,1000,20,1,2.00,1.00,20.00"]), None)
    f["weights"] = (_daily("Day,Campaign,Landing page views,Impr.,Clicks,CTR",
                           lambda i: ["A,100,1000,100,10.0", "B,1000,100,1,1.0"]), None)
    f["no_weight"] = (_daily("Day,Campaign,Cost,Purchases,Cost per add to cart",
                             lambda i: ["A,100,10,5", "B,900,1,25"]), None)
    f["blank_rate"] = (_daily("Day,Campaign,Cost,Cost per purchase", lambda i: [
        "A,100,20", "B,200,40", "C,300,-"]), None)
    f["percent"] = (_daily("Day,Campaign,CTR", lambda i: ["A,3.00%", "B,4.00%", "C,5.00%"]), None)
    f["blanks"] = (_daily("Day,Campaign,Cost,Clicks,Purchases,Indicator", lambda i: [
        f"Live,{100 + i},{'' if i % 37 == 0 else 20 + i},{'-' if i % 37 == 0 else i % 7},purchase",
        f"Live Two,{60 + i},{10 + i},{i % 5},purchase"], n=120), None)
    f["extra"] = (_daily("Day,Campaign,Cost,Clicks,Quality score,Days since launch", lambda i: [
        f"Live,{100 + i},{20 + i},7,{i}", f"Two,{60 + i},{10 + i},5,{i}"]), None)
    f["unknown"] = (_daily("date,ramp,flat,wave", lambda i: [f"{i},500,{i % 7}"]), None)
    f["renamed"] = (_daily("Day,Campaign ID,Campaign,Cost", lambda i: [
        f"111,Brand,{100 + i}",
        f"222,{'Summer Sale' if i < 60 else 'Autumn Sale'},{50 + i}"], n=120), None)
    f["shared_name"] = (_daily("Day,Campaign ID,Campaign,Cost", lambda i: [
        f"111,Sale,{100 + i}", f"222,Sale,{50 + i}"]), None)
    f["multiline"] = (_daily("Day,Campaign,Cost", lambda i: [
        f'"Brand, ""big""\nline two",{i}', f"Plain,{i * 2}"]), None)
    return f


@pytest.fixture(scope="module")
def batch(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for name, (body, _) in _files().items():
        put(folder, f"{name}.csv", body)
    put(folder, ".hidden.csv", "x")
    put(folder, "notes.txt", "x")
    put(folder, "UPPER.CSV", _files()["good"][0])
    return read_batch(exports.read_lines(spark, folder), max_columns=512)


@pytest.fixture(scope="module")
def panel(batch):
    return {
        (r["source"], r["entity"], r["metric"], str(r["day"])): r["value"]
        for r in batch.panel.collect()
    }


@pytest.fixture(scope="module")
def columns(batch):
    return {(r["source"], r["name"]): r for r in batch.columns.collect()}


def test_first_rule_of_every_source(batch):
    got = {r["source"]: r["rule"] for r in Q.first_violation(batch.violations).collect()}
    want = {n: rule for n, (_, rule) in _files().items() if rule}
    assert got == want


def test_details(batch):
    rows = batch.violations.collect()
    by = {(r["source"], r["rule"]): r for r in rows}
    assert by["oops", "bad_cell"]["row_num"] == 5
    assert by["oops", "bad_cell"]["column_name"] == "Cost"
    assert str(by["gap", "day_gap"]["day"]) == day(21)
    assert by["weekly", "segmented"]["detail"] == "weekly"
    assert by["second_column", "unreadable_date"]["column_name"] == "Day"
    assert by["title", "too_few_columns"]["detail"] == "title rows"
    assert by["two_groups", "group_column"]["detail"] == "several"
    assert by["only_measures", "group_column"]["detail"] == "only_measures"
    assert {by[n, "not_a_csv"]["detail"] for n in ("book", "doc", "u16", "tabs", "semi")} == {
        "zip", "pdf", "utf-16", "tabs", "semicolons"}
    twice = {(r["rule"], r["entity"], str(r["day"])) for r in rows if r["source"] == "twice"}
    assert {("entity_twice", "Brand", day(20)), ("entity_missing", "Sale", day(20))} <= twice


def test_sources_and_days(batch):
    stats = {r["source"]: r for r in batch.stats.collect()}
    assert "UPPER.CSV" in stats and ".hidden" not in stats and "notes" not in stats
    for name in ("good", "newest_first", "no_header", "bom", "crlf", "blank_lines", "dmy", "mdy"):
        assert (stats[name]["n_days"], str(stats[name]["last_day"])) == (40, day(39)), name


def test_roles(columns):
    def role(source, name):
        return columns[source, name]["role"]

    assert role("campaigns", "Campaign status") == role("campaigns", "Campaign") == "text"
    assert role("campaigns", "Campaign ID") == "identifier"
    assert role("campaigns", "Budget") == "setting"
    assert role("campaigns", "Cost") == role("campaigns", "Impr.") == "metric"
    assert role("extra", "Quality score") == role("extra", "Days since launch") == "not_metric"
    assert all(role("unknown", n) == "metric" for n in ("ramp", "flat", "wave"))
    assert all(role("blanks", n) == "metric" for n in ("Cost", "Clicks", "Purchases"))
    assert role("blanks", "Indicator") == "text"
    assert ("no_header", "value") in columns and ("bom", "spend") in columns


def test_blended_rates(panel, columns):
    def account(source, metric):
        return panel[source, "(account)", metric, day(0)]

    assert account("rates", "CTR") == pytest.approx(100 * 120 / 11000)
    assert account("rates", "Avg. CPC") == pytest.approx(320 / 120)
    assert account("rates", "Cost / conv.") == pytest.approx(320 / 11)
    assert account("rates", "Cost") == 320 and account("rates", "Clicks") == 120
    assert account("weights", "CTR") == pytest.approx(101 / 1100 * 100)
    assert columns["weights", "CTR"]["weighted_by"] == "Impr."
    assert account("no_weight", "Cost per add to cart") == 15
    assert columns["no_weight", "Cost per add to cart"]["weighted_by"] is None
    assert account("blank_rate", "Cost per purchase") == 30
    assert account("percent", "CTR") == 4 and columns["percent", "CTR"]["is_percent"]
    assert panel["blanks", "Live", "Clicks", day(0)] == 0


def test_entity_states(batch):
    got = {(r["source"], r["entity"]): r["state"] for r in batch.states.collect()}
    assert got["campaigns", "Zombie"] == "paused" and got["campaigns", "Brand"] == "live"
    assert got["flat", "Flat"] == "flat" and got["flat", "Live"] == "live"
    assert got["flat", "(account)"] == "live"


def test_labels(batch, panel):
    groups = {r["source"]: r["group_by"] for r in batch.groups.collect()}
    labels = {(r["source"], r["key"]): r for r in batch.labels.collect()}
    assert groups["campaigns"] == "Campaign"
    assert groups["renamed"] == "Campaign ID"
    assert labels["renamed", "222"]["label"] == "Autumn Sale" and labels["renamed", "222"]["renamed"]
    assert not labels["renamed", "111"]["renamed"]
    assert panel["renamed", "Autumn Sale", "Cost", day(0)] == 50
    assert groups["shared_name"] == "Campaign ID"
    assert labels["shared_name", "111"]["label"] == "Sale (111)"


def test_quoted_cells(panel):
    entity = 'Brand, "big"line two'
    assert panel["multiline", entity, "Cost", day(3)] == 3


def test_total_is_the_sum_of_entities(panel):
    for i in (0, 50, 89):
        total = panel["campaigns", "(account)", "Cost", day(i)]
        parts = sum(panel["campaigns", e, "Cost", day(i)] for e in ("Brand", "Generic", "Zombie"))
        assert total == pytest.approx(parts)
