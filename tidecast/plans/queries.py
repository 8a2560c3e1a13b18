"""Registered queries: every operator over whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast import fixed
from tidecast.functions import names as N
from tidecast.functions import text as X
from tidecast.functions.cells import with_numbers
from tidecast.operators import accuracy as A
from tidecast.operators import backtest as B
from tidecast.operators import columns as C
from tidecast.operators import dates as D
from tidecast.operators import forecast as M
from tidecast.operators import panel as P
from tidecast.operators import quality as Q
from tidecast.operators import records as R
from tidecast.operators import regression as G
from tidecast.operators import report as O
from tidecast.plans.import_job import import_folder, import_lines, read_batch
from tidecast.plans.understand import understand
from tidecast.session import landed, scratch_path
from tidecast.sources import store as S
from tidecast.sources.files import Files
from tidecast.sources import tables as T
from tidecast.streaming import live_accuracy as L
from tidecast.streaming.closed_days import close_days, closed_days, read_days, write_closed_days

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
HORIZON = 7


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _r(name: str, digits: int = 6):
    """Rounded for comparison, negative zero made plain."""
    return (F.round(name, digits) + F.lit(0.0)).alias(name)


def _p(path: str, name: str):
    return (F.round(F.col(path), 4) + F.lit(0.0)).alias(name)


def _none(name: str):
    return F.lit(None).cast("double").alias(name)


def _big(name: str):
    return F.col(name).cast("bigint").alias(name)


def _dated(records: DataFrame) -> DataFrame:
    """Dated rows. The order, one row per source, is stored so that its size is known."""
    return D.dated_rows(records, landed(D.date_order(records), "order"))


def _classified(spark, sf, export=T.campaign_export):
    """Dated rows, read from the export and written once, and column metadata."""
    records, headers = export(spark, sf)
    read = landed(D.read_days(records), "rows")
    rows = D.in_order(read, landed(D.order_of(read), "order"))
    stats = landed(D.day_stats(D.rows_per_day(rows)), "stats")
    named = landed(C.name_columns(C.column_profile(rows), headers), "named")
    columns = landed(C.choose_weights(C.classify(named, stats)), "columns")
    return rows, stats, columns


# --- records and cells ---------------------------------------------------------------


@query
def csv_records(spark, sf):
    """Quoted commas, doubled quotes and line breaks inside cells."""
    orders = T.table(spark, sf, "orders")
    key = F.col("o_orderkey").cast("string")
    one = F.concat(key, F.lit(', "a ""b"", '), F.col("o_orderpriority"), F.lit('",x'))
    head = F.concat(key, F.lit(',"line one,'))
    tail = F.concat(F.col("o_orderpriority"), F.lit('",y\r'))
    parts = F.when(F.col("o_orderstatus") == "P", F.array(head, tail)).otherwise(F.array(one))
    lines = orders.select(
        F.lit("orders").alias("source"),
        F.floor(F.col("o_orderkey") / 4096).alias("block"),
        F.col("o_orderkey"),
        F.posexplode(parts).alias("i", "text"),
    ).select("source", "block", (F.col("o_orderkey") * 2 + F.col("i")).alias("line_id"), "text")
    parsed = R.parse_records(R.to_records(lines))
    return parsed.select(
        _big("row_num"),
        F.col("cells")[0].alias("key"),
        F.col("cells")[1].alias("note"),
        F.col("cells")[2].alias("mark"),
        F.size("cells").alias("width"),
        "malformed",
    )


@query
def clean_cells(spark, sf):
    records, _ = T.order_export(spark, sf)
    cells = {"cost": F.col("cells")[5], "clicks": F.col("cells")[6], "share": F.col("cells")[7]}
    return with_numbers(records, cells).select(
        "source", _big("row_num"), _r("cost", 2), "cost_percent", _r("clicks", 2),
        "clicks_no_data", _r("share", 2), "share_percent",
    )


@query
def cell_no_data(spark, sf):
    records, _ = T.order_export(spark, sf)
    read = with_numbers(records, {"clicks": F.col("cells")[6]})
    return read.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if("clicks_no_data").alias("n_no_data"),
        F.sum("clicks").alias("clicks"),
    )


@query
def parse_dates(spark, sf):
    records, _ = T.order_export(spark, sf)
    return _dated(records).select("source", _big("row_num"), "day")


@query
def date_order(spark, sf):
    return D.date_order(T.order_export(spark, sf)[0])


@query
def unreadable_dates(spark, sf):
    """Sources whose first column holds something else; the header says where dates are."""
    records, headers = T.order_export(spark, sf)
    swapped = records.withColumn(
        "cells", F.concat(F.slice("cells", 2, 1), F.slice("cells", 1, 1), F.slice("cells", 3, 9))
    )
    header = headers.withColumn(
        "header",
        F.concat(F.slice("header", 2, 1), F.slice("header", 1, 1), F.slice("header", 3, 9)),
    )
    bad = Q.unreadable_dates(_dated(swapped), header)
    return bad.select("source", _big("row_num"), "column_name", "detail", "n")


# --- columns -------------------------------------------------------------------------


@query
def column_profile(spark, sf):
    records, _ = T.order_export(spark, sf)
    return C.column_profile(_dated(records)).select(
        "source", "col_idx", "n_cells", "n_bad", "is_percent", "first_is_text", "n_blank",
        "n_state", "n_other",
    )


@query
def percent_flags(spark, sf):
    records, headers = T.order_export(spark, sf)
    named = C.name_columns(C.column_profile(_dated(records)), headers)
    return named.where("is_percent").select("source", "name", "n_cells")


@query
def column_roles(spark, sf):
    _, _, columns = _classified(spark, sf)
    return columns.select("source", "col_idx", "name", "role", "concept", "averaged", "is_percent")


@query
def metric_concepts(spark, sf):
    name = F.col("name")
    out = T.header_names(spark, sf).withColumn("concept", N.concept(name))
    return out.select(
        "name", "n", "concept",
        F.coalesce(N.is_addable(F.col("concept")), F.lit(True)).alias("addable"),
        N.is_identifier(name).alias("identifier"),
        N.is_setting(name).alias("setting"),
        N.is_ratio_name(name).alias("ratio"),
    )


@query
def rate_denominators(spark, sf):
    name = F.col("name")
    return T.header_names(spark, sf).select(
        "name", "n", N.rate_denominator(name).alias("denominator"),
        N.denominator_phrase(name).alias("phrase"),
    )


@query
def weight_choice(spark, sf):
    _, _, columns = _classified(spark, sf)
    return O.rate_explanations(columns)


@query
def bad_cells(spark, sf):
    """A column with a few words among its numbers is a typo that names its first row."""
    records, headers = T.order_export(spark, sf)
    customer = F.element_at("cells", 5)
    spoiled = records.withColumn(
        "cells",
        F.transform(
            "cells",
            lambda c, i: F.when((i == 6) & customer.endswith("99"), F.lit("oops")).otherwise(c),
        ),
    )
    named = C.name_columns(C.column_profile(_dated(spoiled)), headers)
    return Q.bad_cells(named).select("source", "column_name", _big("row_num"), "detail")


@query
def group_column(spark, sf):
    rows, stats, columns = _classified(spark, sf)
    dense = C.group_columns(columns, C.label_stats(rows, columns), stats)
    rows2, stats2, columns2 = _classified(spark, sf, T.ragged_export)
    ragged = C.group_columns(columns2, C.label_stats(rows2, columns2), stats2)
    return dense.unionByName(ragged).select("source", "group_by", "verdict")


@query
def near_duplicates(spark, sf):
    """Segments spelled in two ways."""
    records, headers = T.order_export(spark, sf)
    mixed = records.withColumn(
        "cells",
        F.transform(
            "cells",
            lambda c, i: F.when((i == 1) & (F.col("cells")[2] == "Paused"), F.lower(c)).otherwise(c),
        ),
    )
    groups = headers.select("source", F.lit(1).alias("group_idx"))
    return C.near_duplicates(mixed, groups).select("source", "folded", _big("spellings"))


@query
def one_currency(spark, sf):
    rows, stats, columns = _classified(spark, sf, T.order_export)
    return C.currency_columns(rows, columns).select("source", "currency", "mixed")


# --- days and entities ------------------------------------------------------------------


@query
def rows_per_day(spark, sf):
    rows = _dated(T.ragged_export(spark, sf)[0])
    return D.rows_per_day(rows).select("source", "day", "n_rows")


@query
def uneven_days(spark, sf):
    per_day = D.rows_per_day(_dated(T.ragged_export(spark, sf)[0]))
    return Q.uneven_days(per_day, D.day_stats(per_day)).select("source", "day", "detail", "n")


def _spans(spark, sf, entity="c_nationkey"):
    records, headers = T.ragged_export(spark, sf, entity)
    order = landed(D.date_order(records), "order")
    rows = landed(D.dated_rows(records, order), "rows")
    stats = landed(D.day_stats(D.rows_per_day(rows)), "stats")
    labels = headers.select("source", F.lit(1).alias("label_idx"))
    return rows, headers, order, stats, P.entity_spans(rows, labels)


@query
def entity_span(spark, sf):
    spans = _spans(spark, sf)[4]
    return spans.select(
        "source", "entity", "first_day", "last_day", F.size("seen").alias("n_days")
    )


@query
def fill_absent(spark, sf):
    rows, headers, order, stats, spans = _spans(spark, sf)
    named = landed(C.name_columns(C.column_profile(rows), headers), "named")
    filled = P.fill_absent(rows, landed(spans, "spans"), stats, named, order).where("filled")
    return filled.select(
        "source", "day", F.col("cells")[1].alias("entity"), F.col("cells")[0].alias("written"),
        F.col("cells")[2].alias("cost"), F.col("cells")[3].alias("orders"),
    )


@query
def interior_holes(spark, sf):
    _, _, _, stats, spans = _spans(spark, sf, "c_mktsegment")
    return P.interior_holes(spans, stats).select("source", "entity", "day", _big("n"))


@query
def stopped_entities(spark, sf):
    _, _, _, stats, spans = _spans(spark, sf)
    return P.stopped_entities(spans, stats)


@query
def flat_entities(spark, sf):
    """Customers who never order more or less than the same number per day."""
    orders = T.table(spark, sf, "orders")
    panel = orders.groupBy(
        F.col("o_orderpriority").alias("source"),
        F.col("o_custkey").cast("string").alias("entity"),
        F.col("o_orderdate").cast("date").alias("day"),
    ).agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("metric", F.lit("Orders"))
    columns = orders.select(F.col("o_orderpriority").alias("source")).distinct().select(
        "source", F.lit("Orders").alias("name"), F.lit("metric").alias("role")
    )
    return P.flat_entities(panel, columns)


def _campaign_states(spark, sf):
    rows, stats, columns = _classified(spark, sf)
    groups = C.group_columns(columns, C.label_stats(rows, columns), stats)
    status = C.status_columns(columns)
    keyed = P.with_status(P.keyed_rows(rows, groups), status)
    panel = P.build_panel(keyed, columns)
    return P.entity_states(panel, columns, P.running_entities(keyed, stats), status)


@query
def entity_states(spark, sf):
    return _campaign_states(spark, sf)


@query
def paused_entities(spark, sf):
    return _campaign_states(spark, sf).where("state = 'paused'").select("source", "entity")


@query
def excluded_entities(spark, sf):
    """Every entity that is stored and not forecast."""
    return O.exclusions(_campaign_states(spark, sf)).select("source", "entity", "state")


@query
def exclusion_lists(spark, sf):
    """The same for a page: how many, and the first few names."""
    excluded = O.exclusion_lists(O.exclusions(_campaign_states(spark, sf)))
    return excluded.select("source", "state", "n", F.array_join("names", ", ").alias("names"))


def _shop_labels(spark, sf):
    rows, _, columns = _classified(spark, sf, T.shop_export)
    groups = columns.where("name = 'Shop ID'").select(
        "source", F.col("col_idx").alias("group_idx"), F.col("name").alias("group_by")
    )
    return C.entity_labels(rows, columns, groups)


@query
def entity_labels(spark, sf):
    return _shop_labels(spark, sf).select("source", "key", "label", "first_name")


@query
def renames(spark, sf):
    return _shop_labels(spark, sf).where("renamed").select("source", "key", "first_name", "label")


@query
def name_collisions(spark, sf):
    shared = _shop_labels(spark, sf).groupBy("source", "last_name").agg(
        F.count(F.lit(1)).alias("n_ids")
    )
    return shared.where("n_ids > 1")


@query
def same_entities(spark, sf):
    rows = landed(_dated(T.ragged_export(spark, sf)[0]), "rows")
    stats = D.day_stats(D.rows_per_day(rows))
    groups = stats.select("source", F.lit(1).alias("group_idx"))
    keyed = P.keyed_rows(rows, groups)
    found = Q.same_entities(Q.entity_days(keyed), stats)
    return found.select("source", "rule", "entity", "day", "n")


def _order_days(spark, sf):
    orders = T.table(spark, sf, "orders")
    return orders.groupBy(
        F.col("o_orderpriority").alias("source"), F.col("o_orderdate").cast("date").alias("day")
    ).agg(F.count(F.lit(1)).alias("n_rows"))


@query
def day_gaps(spark, sf):
    return Q.gaps(Q.day_steps(_order_days(spark, sf)))


@query
def segmentation(spark, sf):
    """Orders by week and by month are not daily exports; by day they are."""
    days = _order_days(spark, sf)

    def by(period):
        return days.groupBy(
            F.concat_ws(" ", F.lit(period), "source").alias("source"),
            F.trunc("day", period).alias("day"),
        ).agg(F.sum("n_rows").alias("n_rows"))

    weeks = by("week").unionByName(
        days.withColumn("source", F.concat_ws(" ", F.lit("day"), "source"))
    )
    return Q.segmentation(Q.day_steps(weeks))


@query
def too_short(spark, sf):
    events = T.table(spark, sf, "events")
    per_day = events.groupBy(
        F.col("event_type").alias("source"), F.col("ts").cast("date").alias("day")
    ).agg(F.count(F.lit(1)).alias("n_rows"))
    found = Q.calendar(per_day, D.day_stats(per_day)).where("rule = 'too_short'")
    return found.select("source", "detail")


@query
def history_verdict(spark, sf):
    per_day = _order_days(spark, sf)
    return D.day_stats(per_day).select(
        "source", _big("n_days"), X.history_verdict(F.col("n_days")).alias("verdict"),
        X.enough_history(F.col("n_days")).alias("enough"),
    )


# --- panel --------------------------------------------------------------------------------


def _campaign_panel(spark, sf):
    rows, stats, columns = _classified(spark, sf)
    groups = columns.where("name = 'Campaign'").select("source", F.col("col_idx").alias("group_idx"))
    return P.build_panel(P.keyed_rows(rows, groups), columns)


@query
def account_totals(spark, sf):
    panel = _campaign_panel(spark, sf)
    sums = panel.where(F.col("metric").isin("Budget", "Cost", "Clicks", "Impr."))
    return sums.where(F.col("entity") == fixed.ACCOUNT).select(
        "source", "metric", "day", _r("value", 4)
    )


@query
def entity_series(spark, sf):
    panel = _campaign_panel(spark, sf)
    return panel.where(F.col("entity") != fixed.ACCOUNT).select(
        "source", "entity", "metric", "day", _r("value", 6)
    )


@query
def blended_rates(spark, sf):
    panel = _campaign_panel(spark, sf)
    return panel.where((F.col("metric") == "CTR") & (F.col("entity") == fixed.ACCOUNT)).select(
        "source", "day", _r("value", 4)
    )


@query
def plain_rates(spark, sf):
    panel = _campaign_panel(spark, sf)
    wanted = (F.col("metric") == "Discount rate") & (F.col("entity") == fixed.ACCOUNT)
    return panel.where(wanted).select("source", "day", _r("value", 8))


@query
def item_panel(spark, sf):
    return T.item_panel(spark, sf).select("source", "entity", "metric", "day", _r("value", 4))


@query
def last_n_days(spark, sf):
    return P.last_days(T.item_panel(spark, sf), 90).select(
        "source", "entity", "metric", "day", _r("value", 4)
    )


@query
def window_plan(spark, sf):
    items = T.panel_stats(T.daily_items(spark, sf).withColumn("metric", F.lit("x")))
    events = T.table(spark, sf, "events").select(
        F.col("event_type").alias("source"), F.col("ts").cast("date").alias("day")
    )
    plan = P.window_plan(items.unionByName(T.panel_stats(events)))
    return plan.select("source", "window", _big("window_days"), _big("n_days"))


@query
def raw_json_query(spark, sf):
    events = T.table(spark, sf, "events")
    k = F.get_json_object("props", "$['k']").cast("int").alias("k")
    return events.groupBy("event_type", k).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


# --- forecasts -----------------------------------------------------------------------------


def _item_history(spark, sf, panel=None):
    """Histories by window, exchanged once by series for whatever forecasters follow."""
    panel = T.item_panel(spark, sf) if panel is None else panel
    items = T.daily_items(spark, sf)
    stats = items.groupBy("source").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day")
    ).withColumn("n_days", F.datediff("last_day", "first_day") + 1)
    return T.panel_history(panel, P.window_plan(stats)).repartition(*M.KEYS)


def _long(flight):
    return M.long_form(flight).select(
        "series_id", "entity", "metric", "window", "model", "day", "q_idx", _r("value", 4)
    )


@query
def seasonal_naive(spark, sf):
    return _long(M.seasonal_naive(_item_history(spark, sf), HORIZON))


@query
def weekday_quantile(spark, sf):
    return _long(M.weekday_quantile(_item_history(spark, sf), HORIZON))


@query
def trend_weekday(spark, sf):
    return _long(M.trend_weekday(_item_history(spark, sf), HORIZON))


@query
def covariate_forecast(spark, sf):
    """The other metrics on clicks, those of the days ahead taken as the last week's."""
    panel = T.item_panel(spark, sf)
    history = _item_history(spark, sf, panel).where("metric <> 'Clicks'")
    clicks = panel.where("metric = 'Clicks'").select(
        F.col("source").alias("series_id"), "entity", "day", F.col("value").alias("x")
    )
    ahead = P.last_days(panel.where("metric = 'Clicks'"), HORIZON).select(
        F.col("source").alias("series_id"), "entity",
        F.date_add("day", HORIZON).alias("day"), F.col("value").alias("x"),
    )
    return _long(M.covariate_line(history, clicks, ahead))


@query
def ensemble_average(spark, sf):
    history = _item_history(spark, sf)
    flight = Q.union_all([f(history, HORIZON) for f in M.NATIVE.values()])
    average = M.average_runs(M.averaged_members(flight))
    return M.long_form(average).select(
        "series_id", "entity", "metric", "window", "model", "day", "q_idx", "n_runs",
        _r("value", 4),
    )


def _bent(spark, sf, factors):
    """Flights out of every week of each series, quantiles bent by fixed factors.

    Weeks are counted back from the last day; the oldest may be shorter.
    """
    panel = T.item_panel(spark, sf)
    ends = panel.groupBy("source").agg(F.max("day").alias("end"))
    week = F.floor(F.datediff("end", "day") / HORIZON).cast("int")
    return panel.join(ends, "source").withColumn("week", week).select(
        F.col("source").alias("series_id"), "entity", "metric",
        F.col("week").cast("string").alias("window"), F.lit("bent").alias("model"),
        F.date_sub("end", (F.col("week") + 1) * HORIZON).alias("as_of"), "day",
        F.transform(F.array(*[F.lit(f) for f in factors]), lambda f: F.col("value") * f).alias("q"),
    )


@query
def quantile_repair(spark, sf):
    flight = _bent(spark, sf, [0.9, 0.92, 0.91, 0.95, 1.0, 1.02, 1.01, 1.05, 1.1])
    return M.long_form(M.repaired(flight)).select(
        "series_id", "entity", "metric", "day", "q_idx", _r("value", 4), _r("crossing", 9)
    )


@query
def forecast_contract(spark, sf):
    """Clicks are far out of order, discount rates lack their last day, cost is fine."""
    good = _bent(spark, sf, [0.9, 0.92, 0.91, 0.95, 1.0, 1.02, 1.01, 1.05, 1.1])
    bad = _bent(spark, sf, [0.9, 0.92, 0.91, 0.95, 1.0, 0.5, 1.01, 1.05, 1.1])
    last = F.date_add("as_of", HORIZON)
    short = good.where("metric = 'Discount rate'").where(F.col("day") < last)
    flight = good.where("metric = 'Cost'").unionByName(
        bad.where("metric = 'Clicks'")
    ).unionByName(short)
    return M.contract_violations(flight, HORIZON).select(
        "series_id", "entity", "metric", "window", "problem"
    )


@query
def floor_at_zero(spark, sf):
    flight = _bent(spark, sf, [-0.5, -0.25, -0.1, 0.0, 0.1, 0.5, 1.0, 1.5, 2.0])
    return M.long_form(M.floored(flight)).select(
        "series_id", "entity", "metric", "day", "q_idx", _r("value", 4), _big("clamped")
    )


def _revised_store(spark, sf):
    """A store that was given a run, the same run again, and one over a revised export."""
    key = (spark.sparkContext.applicationId, f"revised {sf}")
    if key in _STORES:
        return S.Store(spark, _STORES[key][0])
    panel = landed(T.item_panel(spark, sf), "panel")
    root = scratch_path(spark, "store")
    store = S.Store(spark, root).create()
    store.save_series(_past(panel, 2))
    groups = panel.select("source", F.lit("Campaign").alias("group_by")).distinct()
    past = landed(_past(panel, HORIZON), "past")
    revised = past.withColumn("value", F.col("value") * 1.5)
    for given in (past, past, revised):
        history = _history_of(given, ["90d"])
        flight = landed(M.weekday_quantile(history, HORIZON), "flight")
        runs = landed(S.make_runs(flight, M.series_hash(history), groups, HORIZON), "runs")
        named = S.identified(flight, runs)
        store.append_runs(runs, S.make_run_entities(named), S.stored_forecasts(named))
    _STORES[key] = [root]
    return store


@query
def revised_runs(spark, sf):
    """Two runs of one series and cut-off day over different input, scored apart."""
    return _revised_store(spark, sf).accuracy_view().select(
        "series_id", "model", "entity", "metric", "day", _r("forecast", 4), _r("actual", 4),
        _r("low", 4), _r("high", 4), "inside_range",
    )


@query
def run_list(spark, sf):
    """Runs of the store, newest first: each run once, however often it was appended."""
    listed = _revised_store(spark, sf).run_list()
    return listed.groupBy("series_id", "model", "horizon").agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_distinct("id").alias("n_ids")
    )


@query
def dataset_list(spark, sf):
    store = _revised_store(spark, sf)
    every = store.datasets().withColumn("asked", F.lit("all"))
    return every.unionByName(store.datasets("f").withColumn("asked", F.lit("f")))


@query
def series_read(spark, sf):
    """One stored series of each dataset, by day."""
    store = _revised_store(spark, sf)
    return Q.union_all([
        store.series_of(x, fixed.ACCOUNT, "Cost").select(
            F.lit(x).alias("series_id"), "day", _r("value", 4))
        for x in ("F", "O")
    ])


@query
def forecast_days(spark, sf):
    store = _revised_store(spark, sf)
    days = O.forecast_days(store.read("forecasts"))
    ids = store.read("runs").select(F.col("id").alias("run_id"), "series_id")
    return days.join(ids, "run_id").groupBy("series_id", "day").agg(F.count(F.lit(1)).alias("n_runs"))


@query
def cleared_store(spark, sf):
    """Rows per dataset before and after a store is cleared; after, every table still reads."""
    store = S.Store(spark, scratch_path(spark, "store")).create()
    store.save_series(T.item_panel(spark, sf))
    before = landed(store.read("series").groupBy("series_id").agg(F.count(F.lit(1)).alias("n")), "n")
    store.clear()
    after = Q.union_all([
        store.read(t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("series_id"), "n")
        for t in S.SCHEMAS
    ])
    return before.unionByName(after)


@query
def input_hash(spark, sf):
    return M.series_hash(_item_history(spark, sf))


@query
def pooled_ridge(spark, sf):
    """Fitted per account; a second account, twice the first, changes nothing in it."""
    history = landed(_item_history(spark, sf), "history")
    other = history.withColumns(
        {"series_id": F.concat(F.lit("copy of "), "series_id"), "value": F.col("value") * 2}
    )
    return _long(M.pooled_ridge(history.unionByName(other), HORIZON))


@query
def fitted_lines(spark, sf):
    """Prices on three inputs and on eight, of which one is constant and one a double; the sums
    of odd months are added to those of even ones before the fit."""
    lines = T.table(spark, sf, "lineitem").withColumn("month", F.month("l_shipdate"))
    keys = ["l_returnflag", "l_linestatus"]
    three = [F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")]
    eight = [*three, F.col("l_linenumber").cast("double"), F.col("l_quantity") * 2, F.lit(3.0),
             F.col("month").cast("double"), F.col("l_quantity") * F.col("l_tax")]
    out = []
    for inputs in (three, eight):
        k = len(inputs)
        rows = lines.select(*keys, F.col("month") % 2 == 1, F.array(*inputs).alias("x"),
                            F.col("l_extendedprice").alias("y")).toDF(*keys, "odd", "x", "y")
        even, odd = (G.moments(rows.where(c), keys, k) for c in ("not odd", "odd"))
        fit = G.fitted(G.added(even, odd, keys, k), k, reg=0.1)
        out.append(fit.select(*keys, F.lit(k).alias("n_inputs"), "n", _r("mean_y", 3),
                              F.posexplode("b").alias("input", "b")))
    return Q.union_all(out).withColumn("b", _r("b", 3))


def _damped_mean(grid):
    """A forecaster of a user's own: quantiles of the last four weeks, every day alike.

    Defined inside a function, so that it travels to the workers by value.
    """

    class DampedMean:
        name = "damped_mean"
        quantiles = grid
        covariates = False

        def forecast(self, past: pd.DataFrame, horizon: int, metrics: list[str], future=None):
            recent = past.tail(28)
            spread = {m: np.quantile(recent[m].to_numpy(), self.quantiles) for m in metrics}
            return {m: [spread[m].tolist()] * horizon for m in metrics}

    return DampedMean()


@query
def own_forecaster(spark, sf):
    return _long(M.with_plugin(_item_history(spark, sf), _damped_mean(fixed.GRID), HORIZON))


@query
def loaded_forecaster(spark, sf):
    """The same model, loaded by the workers instead of travelling with every task."""
    grid = fixed.GRID
    model = M.Loaded("damped_mean", grid, load=lambda: _damped_mean(grid))
    return _long(M.with_plugin(_item_history(spark, sf), model, HORIZON))


WIDE_GRID = [0.01, *[round(0.05 * i, 2) for i in range(1, 20)], 0.99]


@query
def quantile_grids(spark, sf):
    """A model of 21 quantiles beside two of nine; only the nine are averaged."""
    history = _item_history(spark, sf).where("window = '90d'")
    flight = landed(Q.union_all([
        M.with_plugin(history, _damped_mean(WIDE_GRID), HORIZON),
        M.seasonal_naive(history, HORIZON), M.weekday_quantile(history, HORIZON),
    ]), "flight")
    average = M.average_runs(M.averaged_members(flight)).drop("n_runs")
    return M.long_form(flight.unionByName(average)).select(
        "series_id", "entity", "metric", "model", "day", "quantile", _r("value", 4)
    )


@query
def stored_tables(spark, sf):
    """The store that the queries below score and report on: its runs and what they hold."""
    runs, entities, forecasts, series = stored(spark, sf)
    per_run = forecasts.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_values"))
    n_entities = entities.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_entities"))
    n_days = series.groupBy("series_id").agg(F.count_distinct("day").alias("n_days"))
    return runs.withColumnRenamed("id", "run_id").join(per_run, "run_id").join(
        n_entities, "run_id").join(n_days, "series_id").select(
        "series_id", "model", "as_of", "n_values", "n_entities", "n_days")


@query
def backtest(spark, sf):
    """Every week of the whole history as a point to forecast from."""
    panel = landed(T.item_panel(spark, sf), "panel")
    scored = B.walk_forward(panel, T.panel_stats(panel), horizon=HORIZON)
    # A value on the edge of its band is inside it, whatever its last binary digit.
    scored = scored.withColumns({c: F.round(c, 6) for c in ("actual", "low", "high")})
    return B.backtest_summary(scored).select(
        "model", "window", "metric", "n_days", _r("mae", 4), _r("mape", 4), _r("in_range", 4)
    )


# --- scoring stored forecasts ----------------------------------------------------------------


#: Stored tables by session and data folder: what they hold is written once, so that a
#: query over a store reads one.
_STORES: dict[tuple[str, str], list[str]] = {}
STORED_MODELS = [f"{m}@{w}" for m in ("seasonal_naive", "weekday_quantile")
                 for w, _ in fixed.WINDOWS]


def stored(spark, sf):
    """Runs on every window and forecasts a week old; the history lacks the newest two days.

    One of the two models declares that it was fitted through the second forecast day.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORES:
        paths = [scratch_path(spark, x) for x in ("runs", "entities", "forecasts", "series")]
        for path, df in zip(paths, _to_store(spark, sf), strict=True):
            df.write.parquet(path)
        _STORES[key] = paths
    return tuple(spark.read.parquet(p) for p in _STORES[key])


def _past(panel, days):
    """The panel without the newest days of each source."""
    last = panel.groupBy("source").agg(F.max("day").alias("end"))
    return panel.join(last, "source").where(F.datediff("end", "day") >= days).drop("end")


def _history_of(panel, windows=None):
    spans = panel.groupBy("source").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day")
    )
    plan = P.window_plan(
        spans.withColumn("n_days", F.datediff("last_day", "first_day") + 1)
    )
    return T.panel_history(panel, plan.where(F.col("window").isin(windows)) if windows else plan)


def _to_store(spark, sf):
    panel = landed(T.item_panel(spark, sf), "panel")
    history = _history_of(_past(panel, HORIZON))
    flight = landed(
        Q.union_all([f(history, HORIZON) for f in (M.seasonal_naive, M.weekday_quantile)]),
        "flight",
    )
    fitted = F.to_json(
        F.struct(F.date_add("as_of", 2).cast("string").alias("trained_through"))
    )
    label = X.run_label(F.col("model"), F.col("window")).alias("model")
    runs = flight.groupBy("series_id", "model", "window", "as_of").agg(
        F.array_sort(F.collect_set("metric")).alias("metrics"),
    ).select(
        S.run_id("series_id", label, "as_of").alias("id"), "series_id", label, "as_of", "metrics",
        F.when(F.col("model") == "weekday_quantile", fitted).otherwise(F.lit("{}")).alias(
            "model_info"
        ),
    )
    runs = landed(runs, "runs")
    named = S.identified(flight, runs)
    forecasts = S.stored_forecasts(named).sort("quantile", "entity", "metric")
    series = _past(panel, 2).select(
        F.col("source").alias("series_id"), "entity", "metric", "day", "value"
    ).sort("day")
    return runs, S.make_run_entities(named), forecasts, series


def _view(spark, sf):
    runs, _, forecasts, series = stored(spark, sf)
    return A.accuracy_view(forecasts, runs, series)


def _scores(view):
    return view.select(
        "series_id", "model", "as_of", "days_ahead", "entity", "metric", "day",
        *[_r(c, 4) for c in ("forecast", "actual", "error", "abs_error", "pct_error", "low",
                             "high")],
        "inside_range", "trained_on", "trained_through",
    )


@query
def forecast_accuracy(spark, sf):
    return _scores(_view(spark, sf))


@query
def accuracy_summary(spark, sf):
    picked = A.select_scores(_view(spark, sf))
    return A.summary(picked).select(
        "model", "metric", "n_days", _r("avg_error", 4), _r("bias", 4), _r("in_range", 4)
    )


@query
def accuracy_by_day(spark, sf):
    out = A.summary(_view(spark, sf), ["model", "metric", "days_ahead"])
    return out.select(
        "model", "metric", "days_ahead", "n_days", _r("avg_error", 4), _r("bias", 4),
        _r("in_range", 4),
    )


@query
def waiting_leaked(spark, sf):
    return A.waiting_and_leaked(_view(spark, sf), ["series_id", "model"])


@query
def known_values(spark, sf):
    runs, _, forecasts, _ = stored(spark, sf)
    return A.known_values(forecasts, runs, "entity").withColumnRenamed("entity", "name").union(
        A.known_values(forecasts, runs, "metric")
    )


# --- report datasets ---------------------------------------------------------------------------


def _lines(spark, sf):
    runs, entities, forecasts, series = stored(spark, sf)
    return O.comparison(O.quantile_arrays(forecasts), runs, entities), runs, series


@query
def report_rows(spark, sf):
    lines, _, _ = _lines(spark, sf)
    return lines.select(
        "series_id", "model", "entity", "metric", "day", _r("low", 4), _r("median", 4),
        _r("high", 4),
    )


@query
def horizon_totals(spark, sf):
    lines, _, series = _lines(spark, sf)
    columns = T.item_columns(series.withColumnRenamed("series_id", "source"))
    return O.horizon_totals(lines, columns).select(
        "series_id", "entity", "metric", "model", "is_rate", _r("total", 4)
    )


@query
def compare_pivot(spark, sf):
    lines, _, _ = _lines(spark, sf)
    return O.compare_pivot(lines, STORED_MODELS).select(
        "series_id", "entity", "metric", "day",
        *[F.round(F.col(f"`{m}`"), 4).alias(m.replace("@", "_")) for m in STORED_MODELS],
    )


@query
def observed_totals(spark, sf):
    _, _, series = _lines(spark, sf)
    return O.observed_totals(series, 90).select(
        "series_id", "entity", "metric", "n_days", _r("observed", 4)
    )


@query
def axis_bounds(spark, sf):
    lines, _, series = _lines(spark, sf)
    return O.axis_bounds(series, lines).select(
        "series_id", "entity", "metric", _r("lo", 4), _r("hi", 4)
    )


@query
def chart_payload(spark, sf):
    """The documents behind charts, read back into their rows."""
    lines, _, series = _lines(spark, sf)
    shape = (
        "days array<date>, actual array<double>, cut int, lines array<struct<model: string, "
        "points: array<struct<day: date, median: double, low: double, high: double>>>>"
    )
    doc = O.chart_payload(series, lines).withColumn("d", F.from_json("payload", shape))
    keys = ["series_id", "entity", "metric"]
    past = doc.select(
        *keys, F.lit("actual").alias("line"),
        F.explode(F.arrays_zip(F.col("d.days").alias("day"), F.col("d.actual").alias("v"))).alias("p"),
        F.col("d.cut").alias("cut"),
    ).select(*keys, "line", "p.day", _p("p.v", "median"), _none("low"), _none("high"), "cut")
    ahead = doc.select(*keys, F.explode("d.lines").alias("l"), F.col("d.cut").alias("cut")).select(
        *keys, F.col("l.model").alias("line"), F.explode("l.points").alias("p"), "cut"
    ).select(*keys, "line", "p.day", _p("p.median", "median"), _p("p.low", "low"),
             _p("p.high", "high"), "cut")
    return past.unionByName(ahead)


@query
def idle_entities(spark, sf):
    """Stored entities that no stored run forecast; runs were asked for the account only."""
    runs, entities, _, series = stored(spark, sf)
    asked = entities.where(F.col("entity") == fixed.ACCOUNT)
    return O.rebuilt(series, runs, asked)[1]


@query
def headline_entity(spark, sf):
    runs, entities, _, _ = stored(spark, sf)
    ids = runs.select(F.col("id").alias("run_id"), "series_id", "model")
    return O.headline_entity(entities).join(ids, "run_id").select("series_id", "model", "entity")


def _order_runs(spark, sf):
    """Every order taken as a run: of a segment, by a model, as of a month."""
    return T.orders_with_customers(spark, sf).select(
        F.format_string("%012d", F.col("o_orderkey")).alias("id"),
        F.col("c_mktsegment").alias("series_id"),
        F.when(F.col("o_orderstatus") == "O", F.lit(fixed.AVERAGE_LABEL))
        .otherwise(F.col("o_orderpriority")).alias("model"),
        F.trunc("day", "year").alias("as_of"),
        F.col("o_orderdate").alias("created_at"),
        F.when(
            F.col("o_orderpriority") == "5-LOW",
            F.lit(json.dumps({"trained_through": "2000-01-01"})),
        ).otherwise(F.lit("{}")).alias("model_info"),
    )


@query
def latest_runs(spark, sf):
    return O.latest_runs(_order_runs(spark, sf)).select("series_id", "model", "as_of", "id")


@query
def drawn_runs(spark, sf):
    latest = O.latest_runs(_order_runs(spark, sf))
    plain = O.drawn_runs(latest).withColumn("page", F.lit("models"))
    both = O.drawn_runs(latest, fitted=True).withColumn("page", F.lit("fitted"))
    return plain.unionByName(both).select("page", "series_id", "model", "id")


@query
def provenance(spark, sf):
    runs = _order_runs(spark, sf).withColumns(
        {"horizon": F.lit(7), "input_hash": F.lit(None).cast("string")}
    )
    return O.provenance(runs).groupBy("series_id", "trained_through").agg(
        F.count(F.lit(1)).alias("n_runs")
    )


@query
def shared_entities(spark, sf):
    """Parts that every line number of a status has."""
    parts = T.table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("series_id"),
        F.col("l_linenumber").alias("run_id"),
        F.col("l_partkey").cast("string").alias("item"),
    )
    runs = parts.select("series_id", F.col("run_id").alias("id")).distinct()
    return O.shared(parts, runs).select("series_id", "item", "after_account")


def _parts_of(spark, sf):
    """Brands as entities of a run per return flag and quantity, in the order of the lines.

    Runs of small quantities were asked for the account as well.
    """
    part = T.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lines = T.table(spark, sf, "lineitem").join(part, "l_partkey")
    seen = lines.select(
        F.col("l_returnflag").alias("series_id"),
        F.concat_ws("/", "l_returnflag", F.col("l_quantity").cast("int")).alias("run_id"),
        F.col("p_brand").alias("entity"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"),
        (F.col("l_quantity") <= 10).alias("small"),
    ).groupBy("series_id", "run_id", "entity").agg(
        F.min("at").alias("position"), F.first("small").alias("small"))
    account = seen.where("small").select(
        "series_id", "run_id", F.lit(fixed.ACCOUNT).alias("entity"),
        F.lit(0).cast("bigint").alias("position")).distinct()
    return seen.drop("small").unionByName(account)


@query
def first_entities(spark, sf):
    """The entity a run's page opens with: the account, or what its file names first."""
    return O.headline_entity(_parts_of(spark, sf))


@query
def entity_order(spark, sf):
    """Brands that every run of a flag has, in the order they are listed."""
    items = _parts_of(spark, sf).withColumnRenamed("entity", "item")
    runs = items.select("series_id", F.col("run_id").alias("id")).distinct()
    return O.in_order(O.shared(items, runs)).select("series_id", "item", "position", _big("rank"))


@query
def runs_without_history(spark, sf):
    """Runs that forecast a return flag their series has no line item of."""
    items = T.table(spark, sf, "lineitem")
    runs = items.groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(
        F.min(F.col("l_suppkey").cast("string")).alias("series_id"),
        F.collect_set("l_returnflag").alias("metrics"),
    )
    # What a supplier has only one line item of is taken as not stored.
    series = items.groupBy(
        F.col("l_suppkey").cast("string").alias("series_id"), F.col("l_returnflag").alias("metric")
    ).agg(F.count(F.lit(1)).alias("n"), F.max("l_linenumber").alias("line")).where(
        "n > 1 and line < 7"
    )
    return O.runs_without_history(runs, series)


@query
def display_values(spark, sf):
    customer = T.table(spark, sf, "customer")
    tiny = F.col("c_custkey") / F.lit(1e9)
    values = customer.select(
        "c_custkey",
        F.posexplode(
            F.array(
                F.col("c_acctbal"), F.col("c_acctbal") / 1000, F.col("c_acctbal") / 1e5,
                tiny * 0, F.col("c_custkey") * F.lit(1e12),
            )
        ).alias("kind", "v"),
    )
    shown = X.display_value(F.col("v"), F.col("kind") == 1)
    return values.select(_big("c_custkey"), "kind", shown.alias("shown"))


# --- the whole way -------------------------------------------------------------------------------


@query
def full_import(spark, sf):
    """CSV lines of two accounts to checked panels: records, dates, columns, groups, rates."""
    batch = read_batch(landed(T.campaign_lines(spark, sf), "lines"))
    good = Q.accepted(batch.panel, batch.violations)
    totals = good.groupBy("source", "entity", "metric").agg(
        F.count(F.lit(1)).alias("n_days"), F.round(F.sum("value"), 3).alias("total")
    )
    return totals.join(batch.states, ["source", "entity"]).select(
        "source", "entity", "metric", "n_days", "total", "state"
    )


@query
def import_scored(spark, sf):
    """CSV lines through the whole import: forecast, averaged, stored, and read by the view."""
    store = S.Store(spark, scratch_path(spark, "store")).create()
    import_lines(landed(T.campaign_lines(spark, sf), "lines"), store, horizon=HORIZON)
    # Averages of short decimals lie on rounding edges, which a last binary digit must not decide.
    view = store.accuracy_view().withColumns(
        {c: F.col(c) + F.lit(1e-7) for c in ("forecast", "low", "high")})
    return view.select(
        "series_id", "model", "entity", "metric", "day", _r("forecast", 3), _r("low", 3),
        _r("high", 3), "actual", "trained_on",
    )


@query
def violation_counts(spark, sf):
    """Every rule at once over exports that break several: how often each is broken."""
    records, headers = T.ragged_export(spark, sf)
    batch = understand(records, headers, land=True)
    return batch.violations.groupBy("source", "rule").agg(F.sum("n").alias("n"))


@query
def broken_exports(spark, sf):
    """Exports that are each broken in one way: the rule that is met first, and where."""
    lines = landed(T.broken_lines(spark, sf), "lines")
    batch = read_batch(lines, max_columns=T.MOST_COLUMNS)
    return Q.first_violation(batch.violations).select(
        "source", "rule", "row_num", "day", "entity", "column_name", "detail", "n")


def _items_spelt_twice(spark, sf):
    """Rows per item and day; on one day an item is written in small letters."""
    daily = T.dense(T.daily_items(spark, sf)).select("source", "entity", "day")
    first = daily.groupBy("source").agg(F.min("day").alias("first"))
    at = F.datediff("day", "first")
    name = F.when((at == 40) & (F.col("entity") == "A"), F.lower("entity")).otherwise(F.col("entity"))
    rows = daily.join(first, "source").select(
        "source", (at * 10 + F.ascii("entity") % 10 + 2).cast("long").alias("row_num"),
        F.array(F.col("day").cast("string"), F.concat(F.lit("Item "), name), F.lit("one"),
                (at % 7).cast("string")).alias("cells"))
    names = F.array(*map(F.lit, ["Day", "Item", "Team", "Clicks"]))
    return rows, first.select("source", names.alias("header"))


@query
def group_hints(spark, sf):
    """Splits that are asked for and do not fit: by a name spelt two ways, by one too few."""
    rows, stats, columns = _classified(spark, sf, _items_spelt_twice)
    labels = landed(C.label_stats(rows, columns), "labels")
    found = [
        Q.group_rules(C.group_columns(columns, labels, stats, asked), rows, columns, stats)
        .select("source", F.lit(asked).alias("asked"), "rule", "detail")
        for asked in ("item", "Team", "Clicks", "Nothing")
    ]
    return Q.union_all(found)


@query
def refused_requests(spark, sf):
    """What a forecast is asked for that an account has not: columns, entities, coming values."""
    records, headers = T.campaign_export(spark, sf)
    batch = understand(records, headers, land=True)
    ahead = landed(batch.stats.select("source", F.explode(F.expr(
        "array_union(transform(sequence(1, 7), x -> struct('Cost' AS metric, x AS step)), "
        "array(struct('Clicks' AS metric, 1 AS step), struct('No such' AS metric, 1 AS step)))"
    )).alias("f")).select("source", "f.metric", "f.step", F.lit(1.0).alias("value")), "ahead")
    found = Q.union_all([
        Q.requested_columns(batch.columns, ["cost", "Campaign", "No such"]),
        Q.requested_entities(batch.states, ["account", "nobody"]),
        Q.future_inputs(batch.columns, ahead, HORIZON),
    ])
    return found.select("source", "rule", "entity", "column_name", "detail")


# --- storage and streams --------------------------------------------------------------------------


@query
def store_replace(spark, sf):
    """A dataset stored twice holds only the second version; another stays untouched."""
    store = S.Store(spark, scratch_path(spark, "store")).create()
    panel = landed(T.item_panel(spark, sf), "panel")
    store.save_series(panel)
    store.save_series(P.last_days(panel.where("source = 'F'"), 30))
    return store.read("series").groupBy("series_id", "entity", "metric").agg(
        F.count(F.lit(1)).alias("n_days"), F.round(F.sum("value"), 3).alias("total")
    )


class _Died(RuntimeError):
    """A job that ends between two of its writes."""


@query
def published_versions(spark, sf):
    """Two versions of a store, each as it was published; a change that died is in neither."""
    store = S.Store(spark, scratch_path(spark, "store")).create()
    panel = landed(T.item_panel(spark, sf), "panel")
    store.save_series(panel)
    try:
        with store.change() as change:
            change.clear()
            change.save_series(panel.where("source = 'O'").withColumn("value", F.lit(0.0)))
            raise _Died
    except _Died:
        store.save_series(P.last_days(panel.where("source = 'F'"), 30))
    return Q.union_all([
        store.at(v).read("series").groupBy("series_id", "entity", "metric").agg(
            F.count(F.lit(1)).alias("n_days"), F.round(F.sum("value"), 3).alias("total")
        ).withColumn("version", F.lit(v)) for v in store.versions()[1:]
    ])


@query
def repeated_append(spark, sf):
    """A run whose job died before it was published, then done twice: each value stored once."""
    store = S.Store(spark, scratch_path(spark, "store")).create()
    past = landed(_past(T.item_panel(spark, sf), HORIZON), "past")
    history = _history_of(past)
    flight = landed(M.weekday_quantile(history, HORIZON), "flight")
    groups = past.select("source", F.lit("Campaign").alias("group_by")).distinct()
    runs = landed(S.make_runs(flight, M.series_hash(history), groups, HORIZON), "runs")
    named = S.identified(flight, runs)
    given = runs, S.make_run_entities(named), S.stored_forecasts(named)
    try:
        with store.change() as change:
            change.append_runs(*given)
            raise _Died
    except _Died:
        for _ in range(2):
            store.append_runs(*given)
    ids = store.read("runs").select(F.col("id").alias("run_id"), "series_id", "model")
    rows = store.read("forecasts").join(ids, "run_id")
    return rows.groupBy("series_id", "model", "entity", "metric", "day", "q_idx").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 4).alias("value"))


def _drop(panel, folder, days=0):
    """The account's clicks as one file per source, without the newest days."""
    spark, files = panel.sparkSession, Files(panel.sparkSession)
    clicks = _past(panel, days).where(
        (F.col("entity") == fixed.ACCOUNT) & (F.col("metric") == "Clicks"))
    line = F.concat_ws(",", "day", F.col("value").cast("long")).alias("value")
    made = scratch_path(spark, "drop")
    head = clicks.select("source", F.lit("").alias("day"), F.lit("Day,Clicks").alias("value"))
    body = clicks.select("source", F.col("day").cast("string").alias("day"), line)
    lines = body.unionByName(head.distinct()).repartition("source").sortWithinPartitions("source", "day")
    lines.select("source", "value").write.partitionBy("source").text(made)
    for name in files.names(made):
        if name.startswith("source="):
            part = next(x for x in files.names(f"{made}/{name}") if x.startswith("part"))
            target = f"{folder}/{name.partition('=')[2]}.csv"
            files.delete(target)
            files.move(f"{made}/{name}/{part}", target)


@query
def ledger_import(spark, sf):
    """A folder imported three times: all of it, nothing, and the one file that was revised."""
    folder, archive = scratch_path(spark, "inbox"), scratch_path(spark, "archive")
    files = Files(spark)
    files.make(folder)
    store = S.Store(spark, scratch_path(spark, "store")).create()
    panel = landed(T.item_panel(spark, sf), "panel")
    options = {"models": ["seasonal_naive"], "horizon": HORIZON}
    _drop(panel, folder)
    import_folder(spark, folder, store, archive, **options)
    import_folder(spark, folder, store, archive, **options)
    _drop(panel.where("source = 'F'"), folder, days=10)
    import_folder(spark, folder, store, archive, **options)
    reads = store.read("files").groupBy(F.col("source").alias("series_id")).agg(
        F.count_if("imported").alias("n_imports"))
    runs = store.read("runs").groupBy("series_id").agg(F.count(F.lit(1)).alias("n_runs"))
    kept = spark.createDataFrame([(n,) for n in files.names(archive)], "name string").groupBy(
        F.substring("name", 1, 1).alias("series_id")).agg(F.count(F.lit(1)).alias("n_archived"))
    stored_rows = store.read("series").groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_days"), F.sum("value").alias("clicks"))
    out = stored_rows
    for other in (reads, runs, kept):
        out = out.join(other, "series_id")
    return out


@query
def stored_raw(spark, sf):
    """Raw rows keyed by column name, read back by name."""
    store = S.Store(spark, scratch_path(spark, "store")).create()
    records, headers = T.campaign_export(spark, sf)
    store.save_raw(_dated(records), headers)
    raw = store.read("raw")
    status = F.col("data")["Campaign status"].alias("status")
    cost = with_numbers(raw, {"cost": F.col("data")["Cost"]})
    return cost.groupBy("source", status).agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("cost"), 2).alias("cost")
    )


@query
def closed_days_stream(spark, sf):
    """Days of the event stream that are over; the newest day stays open."""
    schema = T.table(spark, sf, "events").schema
    stream = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf)
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )
    out, progress = scratch_path(spark, "closed"), scratch_path(spark, "progress")
    write_closed_days(closed_days(stream, "0 seconds"), out, progress).awaitTermination()
    return spark.read.parquet(out).select("entity", "day", "n_events", _r("total", 4))


@query
def scored_streams(spark, sf):
    """Runs and actuals that come in turn, scored as both arrive; a last row of each closes all."""
    runs, _, forecasts, series = stored(spark, sf)
    first = runs.agg(F.min("as_of")).scalar()
    days = landed(L.forecast_days(forecasts, runs), "forecast-days")
    came = landed(series.where(F.col("day") > first).select(
        "series_id", "entity", "metric", "day", "value"), "actuals")
    last = days.agg(F.max("day")).first()[0]
    end = {"series_id": F.lit("(end)"), "day": F.date_add(F.lit(last), 60)}
    odd = F.datediff(F.col("day"), F.lit(last)) % 2 != 0
    naive = F.col("model").startswith("seasonal")
    inbox, out, progress = (scratch_path(spark, x) for x in ("inbox", "scored", "progress"))
    turns = [(days.where(naive), came.where("false")), (days.where("false"), came.where(odd)),
             (days.where(~naive), came.where(~odd)),
             (days.limit(1).withColumns(end), came.limit(1).withColumns(end))]
    for new_days, new_actuals in turns:
        new_days.write.mode("append").parquet(f"{inbox}/forecasts")
        new_actuals.write.mode("append").parquet(f"{inbox}/actuals")
        streams = [spark.readStream.schema(df.schema).parquet(f"{inbox}/{name}")
                   for df, name in ((days, "forecasts"), (came, "actuals"))]
        L.score_streams(*streams, wait="30 days").writeStream.format("parquet").option(
            "checkpointLocation", progress).trigger(availableNow=True).start(out).awaitTermination()
    return _scores(spark.read.parquet(out).where("series_id <> '(end)'"))


@query
def late_events(spark, sf):
    """Events in six arrivals, a few of them late by one or two: no row is in none of the three."""
    events = T.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    span = events.agg(F.min(F.col("ts").cast("date")).alias("lo"), F.max(F.col("ts").cast("date")).alias("hi"))
    lo, hi = span.first()
    index = F.floor(F.datediff(F.col("ts").cast("date"), F.lit(lo)) * 4 / ((hi - lo).days + 1))
    delay = F.when(F.col("event_id") % 50 == 0, 2).when(F.col("event_id") % 20 == 0, 1).otherwise(0)
    arrivals = landed(events.select("event_id", "ts", "event_type", "value",
                                    (index + delay).cast("int").alias("arrival")), "arrivals")
    inbox, root, progress = (scratch_path(spark, x) for x in ("inbox", "days", "progress"))
    for k in range(6):
        arrivals.where(F.col("arrival") == k).drop("arrival").write.parquet(f"{inbox}/{k}")
        stream = spark.readStream.schema(arrivals.drop("arrival").schema).parquet(f"{inbox}/*")
        close_days(stream, root, progress, "1 day").awaitTermination()
    closed, still_open, late = read_days(spark, root)
    late = late.groupBy(F.col("event_type").alias("entity"), F.col("ts").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total"))
    return Q.union_all([
        df.select(F.lit(kind).alias("kind"), "entity", "day", "n_events", _r("total", 4))
        for kind, df in (("closed", closed), ("open", still_open), ("late", late))])
