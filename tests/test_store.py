"""Storing, replacing, scoring and re-reading: whole jobs on small folders."""

from __future__ import annotations

import datetime as dt
import json
import os
import tempfile

import pytest
from conftest import day, put
from pyspark.sql import functions as F

from tidecast.operators import accuracy as A
from tidecast.operators import report as O
from tidecast.plans.import_job import import_folder
from tidecast.sources import ledger
from tidecast.sources import store as S
from tidecast.sources.exports import read_lines
from tidecast.sources.files import Files
from tidecast.sources.store import Store
from tidecast.streaming.closed_days import (
    close_days,
    closed_days,
    read_days,
    write_closed_days,
)
from tidecast.streaming.drop_folder import start_import
from tidecast.streaming.live_accuracy import forecast_days, score_arrivals, score_streams


def _campaigns(n=100, extra=""):
    out = "Day,Campaign,Campaign status,Cost,Clicks\n"
    for i in range(n):
        out += f"{day(i)},Sale{extra},Enabled,{60 + i % 5},{i % 4}\n"
        out += f"{day(i)},Brand,Enabled,{100 + i % 7},{i % 9}\n"
        out += f"{day(i)},Old,{'Paused' if i > 50 else 'Enabled'},{i % 3},1\n"
    return out


@pytest.fixture(scope="module")
def imported(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    put(folder, "acme.csv", _campaigns())
    put(folder, "bad.csv", "Day,Cost\n2026-01-01,1\n")
    store = Store(spark, folder + "/store").create()
    done = import_folder(
        spark, folder, store, models=["seasonal_naive", "weekday_quantile"], fitted=True
    )
    return done, store


def test_import(imported):
    done, store = imported
    assert {r["source"] for r in done.violations.collect()} == {"bad"}
    runs = {r["model"]: r for r in store.read("runs").collect()}
    assert set(runs) == {"seasonal_naive@full", "seasonal_naive@90d", "weekday_quantile@full",
                         "weekday_quantile@90d", "average@90d", "pooled_ridge@full"}
    assert runs["average@90d"]["n_entities"] == 3
    assert runs["average@90d"]["metrics"] == ["Clicks", "Cost"]
    assert store.read("forecasts").count() == 6 * 3 * 2 * 7 * 9
    assert {r[0] for r in store.read("series").select("entity").distinct().collect()} == {
        "(account)", "Brand", "Sale", "Old"}
    raw = store.read("raw")
    assert raw.count() == 300
    assert raw.where(raw["data"]["Campaign status"] == "Paused").count() == 49
    assert [r["model"] for r in store.run_list().collect()].count("average@90d") == 1


def test_fitted_model_says_what_it_saw(imported):
    _, store = imported
    model = store.read("models").first()
    assert (model["model"], str(model["trained_through"])) == ("pooled_ridge", day(99))
    assert json.loads(model["settings"]) == {"lags": [1, 2], "means": [28], "reg": 0.1}
    view = store.accuracy_view("scores").where("model = 'pooled_ridge@full'")
    assert {r["trained_through"] for r in view.select("trained_through").collect()} == {day(99)}
    other = store.accuracy_view("scores").where("model = 'average@90d'")
    assert other.where("trained_through is not null").count() == 0
    latest = O.latest_runs(store.read("runs"))
    drawn = {r["model"] for r in O.drawn_runs(latest, fitted=True).collect()}
    assert drawn == {"average@90d", "pooled_ridge@full"}


def test_pages(imported):
    _, store = imported
    runs, series = store.read("runs"), store.read("series")
    entities = store.read("run_entities")
    latest = O.latest_runs(runs)
    assert {r["model"] for r in O.drawn_runs(latest).collect()} == {"average@90d"}
    shared = O.shared(entities.withColumnRenamed("entity", "item"), runs)
    ordered = O.in_order(shared).orderBy("rank").collect()
    assert [r["item"] for r in ordered] == ["(account)", "Sale", "Brand"]  # as in the file
    assert [r["entity"] for r in O.rebuilt(series, runs, entities)[1].collect()] == ["Old"]
    lines = O.comparison(O.quantile_arrays(store.read("forecasts")), runs, entities)
    assert lines.count() == 6 * 3 * 2 * 7
    assert {r["entity"] for r in O.headline_entity(entities).collect()} == {"(account)"}
    members = O.provenance(runs).where("model = 'average@90d'").first()["averaged"]
    assert sorted(members) == ["seasonal_naive@90d", "weekday_quantile@90d"]
    assert O.runs_without_history(runs, series).count() == 0
    assert O.runs_without_history(runs, series.where("metric = 'x'")).count() == 6


def test_replace_leaves_other_datasets(spark):
    store = Store(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/store").create()

    def frame(source, entity, n):
        return spark.createDataFrame(
            [(source, entity, "Cost", dt.date(2026, 1, 1) + dt.timedelta(days=i), 1.0)
             for i in range(n)],
            "source string, entity string, metric string, day date, value double")

    store.save_series(frame("a", "old", 5).unionByName(frame("b", "x", 3)))
    store.save_series(frame("a", "new", 2))
    got = {(r["series_id"], r["entity"]) for r in store.read("series").collect()}
    assert got == {("a", "new"), ("b", "x")} and store.read("series").count() == 5
    store.save_series(frame("a", "new", 0), keys=spark.createDataFrame([("a",)], "k string"))
    assert {r["series_id"] for r in store.read("series").collect()} == {"b"}
    store.clear()
    assert store.read("series").count() == 0


def test_a_run_must_be_whole(spark, imported):
    _, store = imported
    run = store.read("runs").limit(1).withColumn("id", F.lit("broken"))
    with pytest.raises(ValueError, match="lacks"):
        whole = store.read("run_entities")
        store.append_runs(run, whole, store.read("forecasts").where("false"))


class Broken(RuntimeError):
    pass


def _rows_of(store):
    return {t: sorted(map(str, store.read(t).collect())) for t in S.SCHEMAS}


def _job(spark, store, n, fresh=False):
    """What an import writes, of small frames: datasets, runs, a model, files."""
    days = [dt.date(2026, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    panel = spark.createDataFrame(
        [(s, "x", "Cost", d, float(n)) for s in ("a", "b") for d in days],
        "source string, entity string, metric string, day date, value double")
    rows = spark.createDataFrame(
        [(s, i, d, ["1", "2"], False) for s in ("a", "b") for i, d in enumerate(days)],
        "source string, row_num long, day date, cells array<string>, filled boolean")
    headers = spark.createDataFrame([(s, ["Day", "Cost"]) for s in ("a", "b")],
                                    "source string, header array<string>")
    columns = spark.createDataFrame([(s, "Cost", "metric", "cost", False, False, None, 1) for s in ("a", "b")],
                                    "source string, name string, role string, concept string, "
                                    "averaged boolean, is_percent boolean, weighted_by string, position int")
    runs = spark.createDataFrame(
        [(f"r{n}", "a", "m", 7, dt.datetime(2026, 2, 1), days[-1], ["Cost"], 1, "", "h", "{}")],
        S.SCHEMAS["runs"])
    entities = spark.createDataFrame([(f"r{n}", "a", "x", 5)], S.SCHEMAS["run_entities"])
    forecasts = spark.createDataFrame(
        [(f"r{n}", "x", "Cost", days[-1] + dt.timedelta(days=1), q, q / 10, 1.0) for q in range(9)],
        S.SCHEMAS["forecasts"])
    files = spark.createDataFrame([(f"/{n}.csv", "a", n, dt.datetime(2026, 2, 1), "d", True,
                                    dt.datetime(2026, 2, 1))], S.SCHEMAS["files"])
    with store.change() as change:
        if fresh:
            change.clear()
        change.save_series(panel)
        change.save_raw(rows, headers)
        change.save_columns(columns)
        change.append_runs(runs, entities, forecasts)
        change.append_models(panel.withColumnRenamed("source", "series_id"), "m")
        change.append("files", files)


STEPS = ["save_series", "save_raw", "save_columns", "append_runs", "append_models", "append"]


def test_a_job_that_fails_at_any_write_changes_nothing(spark, monkeypatch):
    store = Store(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/store").create(buckets=2)
    _job(spark, store, 3)
    before, version = _rows_of(store), store.version()
    assert all(before.values())
    for fresh in (False, True):
        for step in STEPS:
            real = getattr(S.Change, step)

            def broken(self, *args, real=real):
                real(self, *args)  # the files are written, and then the job dies
                raise Broken

            with monkeypatch.context() as m:
                m.setattr(S.Change, step, broken)
                with pytest.raises(Broken):
                    _job(spark, store, 5, fresh)
            assert store.version() == version
        assert _rows_of(store) == before
    with monkeypatch.context() as m:
        m.setattr(Files, "publish", lambda *_: False)
        with pytest.raises(S.StaleStore):
            _job(spark, store, 5)
    assert _rows_of(store) == before

    for _ in range(2):  # repeated, its run is stored once
        _job(spark, store, 5)
    assert store.version() == version + 2 and _rows_of(store.at(version)) == before
    assert sorted(r["id"] for r in store.read("runs").collect()) == ["r3", "r5"]
    assert store.read("forecasts").count() == 18 and store.read("raw").count() == 10
    _job(spark, store, 4, fresh=True)
    assert [r["id"] for r in store.read("runs").collect()] == ["r4"]
    store.sweep(keep=1)
    assert store.versions() == [version + 3] and store.read("series").count() == 8


def test_an_import_that_fails_is_repeated(spark, monkeypatch):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    inbox = folder + "/inbox"
    os.mkdir(inbox)
    put(inbox, "one.csv", _campaigns(95))
    store = Store(spark, folder + "/store").create()

    def broken(*_):
        raise Broken

    with monkeypatch.context() as m:
        m.setattr(S.Change, "append", broken)
        with pytest.raises(Broken):
            import_folder(spark, inbox, store, models=["seasonal_naive"])
    assert store.version() == 0 and not any(_rows_of(store).values())
    import_folder(spark, inbox, store, models=["seasonal_naive"])
    assert store.version() == 1 and store.read("raw").count() == 285
    assert store.read("files").count() == 1 and store.read("runs").count() > 0


def test_two_changes_at_once(spark):
    store = Store(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/store").create(buckets=2)
    panel = spark.createDataFrame(
        [(s, "x", "Cost", dt.date(2026, 1, 1), 1.0) for s in "abcdef"],
        "source string, entity string, metric string, day date, value double")
    with pytest.raises(S.StaleStore), store.change() as slow:
        slow.save_series(panel.where("source = 'a'"))
        store.save_series(panel.where("source <> 'a'"))
    assert {r["series_id"] for r in store.read("series").collect()} == set("bcdef")
    with pytest.raises(ValueError), store.at(0).change():
        pass
    with pytest.raises(ValueError):
        Store(spark, store.root + "-none").read("runs")
    assert Store(spark, store.root).create().version() == 1  # a store that exists is left


def test_ledger(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    inbox, done = folder + "/in +1", folder + "/done"
    os.mkdir(inbox)
    put(inbox, "a.csv", _campaigns(95))
    put(inbox, "a.CSV", _campaigns(96))
    put(inbox, "b + [c] 1.csv", _campaigns(97))
    put(inbox, "bad.csv", "Day,Cost\n2026-01-01,1\n")
    put(inbox, ".hidden.csv", _campaigns(95))
    store = Store(spark, folder + "/store").create()
    options = {"models": ["seasonal_naive"]}
    folder_of = lambda: {n for n in os.listdir(inbox) if not n.startswith(".")}

    import_folder(spark, inbox, store, **options)
    days = {r[0]: r[1] for r in store.read("raw").groupBy("source").count().collect()}
    assert days == {"a": 285, "a.CSV": 288, "b + [c] 1": 291}
    version = store.version()
    again = import_folder(spark, inbox, store, **options)  # only what was refused is read again
    assert {r["source"] for r in again.violations.collect()} == {"bad"}
    assert again.runs.count() == 0 and store.read("files").count() == 3
    os.remove(inbox + "/bad.csv")
    assert import_folder(spark, inbox, store, **options) is None
    assert store.version() == version + 1

    os.utime(inbox + "/a.csv", (1, 1))  # touched: another time, the same lines
    assert import_folder(spark, inbox, store, archive=done, **options) is None
    assert folder_of() == set() and set(os.listdir(done)) >= {"a.csv", "a.CSV", "b + [c] 1.csv"}
    put(inbox, "a.csv", _campaigns(98))
    import_folder(spark, inbox, store, archive=done, **options)
    kept = [n for n in os.listdir(done) if n.startswith("a") and n.endswith(".csv")]
    assert len(kept) == 2 and folder_of() == set()
    assert store.read("raw").where("source = 'a'").count() == 294
    imports = {r[0]: r[1] for r in store.read("files").where("imported").groupBy("source").count().collect()}
    assert imports == {"a": 2, "a.CSV": 1, "b + [c] 1": 1}


def test_digest_sees_order_and_every_line(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    lines = [f"line {i}" for i in range(50)]
    swapped = [*lines[:10], lines[11], lines[10], *lines[12:]]
    for name, some in (("a", lines), ("b", lines), ("c", swapped), ("d", [*lines, lines[-1]])):
        put(folder, f"{name}.csv", "\n".join(some))
    got = {r["source"]: r["digest"] for r in ledger.digests(read_lines(spark, folder)).collect()}
    assert got["a"] == got["b"] and len(set(got.values())) == 3


def _tables(spark, actuals, through=None):
    d = [dt.date(2026, 1, i) for i in range(1, 7)]
    info = "{}" if through is None else f'{{"trained_through": "{through}"}}'
    runs = spark.createDataFrame(
        [("r", "s", "m", d[2], info)],
        "id string, series_id string, model string, as_of date, model_info string")
    bands = [(90, 100, 110), (180, 200, 220), (270, 300, 330)]
    rows = [("r", "(account)", "Cost", d[3 + i], q, float(v))
            for i, b in enumerate(bands) for q, v in zip((0.1, 0.5, 0.9), b, strict=True)]
    forecasts = spark.createDataFrame(
        rows, "run_id string, entity string, metric string, day date, quantile double, value double")
    series = spark.createDataFrame(
        [("s", "(account)", "Cost", d[3 + i], float(v)) for i, v in actuals.items()],
        "series_id string, entity string, metric string, day date, value double")
    return runs, forecasts, series


def test_accuracy_by_hand(spark):
    runs, forecasts, series = _tables(spark, {0: 80, 1: 200})
    view = {r["days_ahead"]: r for r in A.accuracy_view(forecasts, runs, series).collect()}
    assert view[1]["pct_error"] == 25 and view[1]["inside_range"] is False
    assert view[2]["pct_error"] == 0 and view[2]["inside_range"] is True
    assert view[3]["actual"] is None and view[3]["inside_range"] is None
    row = A.summary(A.accuracy_view(forecasts, runs, series)).first()
    assert (row["n_days"], row["avg_error"], row["bias"], row["in_range"]) == (2, 12.5, 12.5, 50)
    counts = A.waiting_and_leaked(A.accuracy_view(forecasts, runs, series)).first()
    assert (counts["waiting"], counts["leaked"]) == (1, 0)


def test_zero_actual_and_trained_days(spark):
    runs, forecasts, series = _tables(spark, {0: 0, 1: 100}, through="2026-01-04")
    view = A.accuracy_view(forecasts, runs, series)
    rows = {r["days_ahead"]: r for r in view.collect()}
    assert rows[1]["pct_error"] is None and rows[1]["trained_on"] and not rows[2]["trained_on"]
    assert A.summary(view).first()["n_days"] == 1
    assert A.waiting_and_leaked(view).first()["leaked"] == 1
    runs, forecasts, series = _tables(spark, {0: 0})
    row = A.summary(A.accuracy_view(forecasts, runs, series)).first()
    assert row["n_days"] == 1 and row["avg_error"] is None


def test_unknown_filter_value(spark):
    runs, forecasts, _ = _tables(spark, {0: 1})
    A.require_known(forecasts, runs, "metric", "cost")
    with pytest.raises(ValueError, match="Cost"):
        A.require_known(forecasts, runs, "metric", "Clicks")
    with pytest.raises(ValueError):
        A.known_values(forecasts, runs, "run_id")


def test_band_is_one_scan(spark, imported):
    _, store = imported
    spark.conf.set("spark.sql.optimizer.dynamicPartitionPruning.enabled", "false")
    view = A.accuracy_view(store.read("forecasts"), store.read("runs"), store.read("series"))
    physical = view._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in physical.splitlines() if "FileScan" in line]
    bands = [line for line in scans if "quantile:double" in line]
    assert len(bands) == 1, physical
    assert "PushedFilters: [In(quantile" in bands[0] and "q_idx" not in bands[0]


def test_drop_folder_stream(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    inbox = folder + "/inbox"
    os.mkdir(inbox)
    store = Store(spark, folder + "/store").create()
    put(inbox, "one.csv", _campaigns(95))

    def run():
        q = start_import(spark, inbox, store, folder + "/progress", models=["seasonal_naive", "weekday_quantile"])
        q.awaitTermination()

    run()
    assert {r[0] for r in store.read("series").select("series_id").distinct().collect()} == {"one"}
    before = store.read("forecasts").count()
    put(inbox, "two.csv", _campaigns(95, extra=" two"))
    run()
    assert {r[0] for r in store.read("series").select("series_id").distinct().collect()} == {
        "one", "two"}
    assert store.read("forecasts").count() == 2 * before
    assert sorted(r["source"] for r in store.read("files").collect()) == ["one", "two"]
    ids = [r["id"] for r in store.read("runs").collect()]
    assert len(ids) == len(set(ids))


def test_closed_days(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = "ts timestamp, event_type string, value double, note string"

    def add(name, rows):
        df = spark.createDataFrame(
            [(t and dt.datetime.fromisoformat(t), e, v, name) for t, e, v in rows], schema)
        df.coalesce(1).write.parquet(f"{folder}/in/{name}")

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in/*")
        write_closed_days(closed_days(stream, "0 seconds"), folder + "/out", folder + "/cp").awaitTermination()
        close_days(stream, folder + "/days", folder + "/cp2", "0 seconds").awaitTermination()
        return [sorted((str(r["day"]) if "day" in r else str(r["ts"]), r[i], r[j]) for r in x.collect())
                for x, i, j in zip(read_days(spark, folder + "/days"), (0, 0, 1), (3, 3, 2), strict=True)]

    add("a", [("2026-01-01T10:00:00", "x", 1.0), ("2026-01-01T12:00:00", "x", 2.0),
              ("2026-01-02T09:00:00", "x", 5.0)])
    assert run() == [[("2026-01-01", "x", 3.0)], [("2026-01-02", "x", 5.0)], []]
    # Late rows: of a closed day, of a type and of a day that had none, and one without a time.
    add("b", [("2026-01-01T23:00:00", "x", 100.0), ("2026-01-01T23:00:00", "y", 50.0),
              ("2025-12-30T01:00:00", "x", 25.0), (None, "x", 9.0),
              ("2026-01-02T10:00:00", "y", 2.0), ("2026-01-03T01:00:00", "x", 7.0)])
    closed, still_open, late = run()
    assert closed == [("2026-01-01", "x", 3.0), ("2026-01-02", "x", 5.0), ("2026-01-02", "y", 2.0)]
    assert still_open == [("2026-01-03", "x", 7.0)]
    assert sorted(v for _, _, v in late) == [9.0, 25.0, 50.0, 100.0]
    assert {r["note"] for r in read_days(spark, folder + "/days")[2].collect()} == {"b"}
    rows = {(str(r["day"]), r["total"]) for r in spark.read.parquet(folder + "/out").collect()}
    assert rows == {("2026-01-01", 3.0), ("2026-01-02", 5.0), ("2026-01-02", 2.0)}


def test_both_sides_of_the_score_arrive(spark, folder):
    """A match comes out at once; what never gets an actual comes out as waiting, once."""
    runs, forecasts, series = _tables(spark, {0: 80, 1: 200})
    days = forecast_days(forecasts, runs)
    want = {(r["run_id"], r["entity"], r["metric"], r["day"]): r
            for r in A.accuracy_view(forecasts, runs, series).collect()}

    def turn(new_days, new_actuals):
        new_days.write.mode("append").parquet(folder + "/f")
        new_actuals.write.mode("append").parquet(folder + "/a")
        streams = [spark.readStream.schema(df.schema).parquet(folder + at)
                   for df, at in ((days, "/f"), (series, "/a"))]
        score_streams(*streams, wait="3 days").writeStream.format("parquet").option(
            "checkpointLocation", folder + "/cp").trigger(availableNow=True).start(
            folder + "/out").awaitTermination()
        return [r for r in spark.read.parquet(folder + "/out").collect() if r["entity"] != "(end)"]

    assert turn(days, series.where("false")) == []
    # A row with nothing in its key meets nothing.
    nobody = series.limit(1).withColumn("entity", F.lit(None).cast("string"))
    early = turn(days.where("false"), series.unionByName(nobody))
    assert {r["actual"] is not None for r in early} == {True}
    end = {"entity": F.lit("(end)"), "day": F.date_add("day", 90)}
    got = turn(days.limit(1).withColumns(end), series.limit(1).withColumns(end))
    assert len(got) == len(want) > len(early)
    for r in got:
        assert r == want[r["run_id"], r["entity"], r["metric"], r["day"]]


def test_scores_as_actuals_arrive(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    runs, forecasts, series = _tables(spark, {0: 80, 1: 200})
    series.write.parquet(folder + "/in")
    stream = spark.readStream.schema(series.schema).parquet(folder + "/in")
    out = score_arrivals(stream, forecasts, runs)
    q = (out.writeStream.format("parquet").option("path", folder + "/out")
         .option("checkpointLocation", folder + "/cp").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r["days_ahead"]: r for r in spark.read.parquet(folder + "/out").collect()}
    assert got[1]["pct_error"] == 25 and got[2]["inside_range"]
