"""Quantile forecasts of every series at once, and the contract they must satisfy.

``history``: series_id, entity, metric, concept, window, as_of, day, value.
A forecaster returns ``FLIGHT`` rows, one per forecast day, with the values ``q`` of that
day at the ``quantiles`` the model declares, both as arrays. Native forecasters are window aggregates over one exchange on
(series, entity, metric, window); a group is one series' calendar.
"""

from __future__ import annotations

import math
import sys
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from types import ModuleType
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast import fixed
from tidecast.functions import names as N
from tidecast.operators import regression

KEYS = ["series_id", "entity", "metric", "window"]
FLIGHT = [*KEYS, "model", "as_of", "day", "quantiles", "q"]


def history_of(inputs: DataFrame, plan: DataFrame) -> DataFrame:
    """Cut a forecast input into the windows its source can fill.

    ``inputs`` is the panel with ``source`` and ``concept``; ``plan`` has one row per
    source and window.
    """
    spans = plan.select("source", "window", "window_days", "as_of")
    inside = (F.col("window_days") == 0) | (
        F.datediff("as_of", "day") < F.col("window_days")
    )
    return (
        inputs.join(spans, "source")
        .where(inside)
        .select(
            F.col("source").alias("series_id"),
            "entity",
            "metric",
            "concept",
            "window",
            "as_of",
            "day",
            "value",
        )
    )


def next_days(as_of: Column, horizon: int) -> Column:
    """The days after the last observation, as an array."""
    return F.sequence(F.date_add(as_of, 1), F.date_add(as_of, horizon))


def _grid() -> Column:
    return F.array(*[F.lit(q) for q in fixed.GRID])


def _native(flight: DataFrame, model: str) -> DataFrame:
    """Rows of a forecaster of this module, which all share one grid."""
    return flight.withColumns({"model": F.lit(model), "quantiles": _grid()}).select(*FLIGHT)


def seasonal_naive(history: DataFrame, horizon: int, season: int = 7) -> DataFrame:
    """The value one season ago, spread by the quantiles of past season-on-season changes.

    A day without a value one season ago starts from the newest value there is.
    """
    by_day = W.partitionBy(*KEYS).orderBy("day")
    back = F.datediff("as_of", "day")
    changes = history.select(
        *KEYS,
        "as_of",
        back.alias("back"),
        "day",
        "value",
        (F.col("value") - F.lag("value", season).over(by_day)).alias("change"),
    )
    per_series = changes.groupBy(*KEYS, "as_of").agg(
        F.percentile("change", _grid()).alias("spread"),
        F.map_from_entries(
            F.collect_list(F.when(F.col("back") < season, F.struct("back", "value")))
        ).alias("last"),
        F.max_by("value", "day").alias("newest"),
    )
    steps = per_series.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    source_back = (F.ceil(F.col("step") / season) * season - F.col("step")).cast("int")
    base = F.coalesce(F.try_element_at("last", source_back), "newest")
    flight = steps.withColumn("base", base).select(
        *KEYS,
        "as_of",
        F.date_add("as_of", F.col("step")).alias("day"),
        F.transform("spread", lambda r: F.col("base") + r).alias("q"),
    )
    return _native(flight, "seasonal_naive")


def weekday_quantile(history: DataFrame, horizon: int) -> DataFrame:
    """The quantiles of what the same weekday has been within the window."""
    per_weekday = history.groupBy(*KEYS, "as_of", F.weekday("day").alias("wd")).agg(
        F.percentile("value", _grid()).alias("q")
    )
    days = F.filter(next_days(F.col("as_of"), horizon), lambda d: F.weekday(d) == F.col("wd"))
    flight = per_weekday.withColumn("day", F.explode(days)).select(*KEYS, "as_of", "day", "q")
    return _native(flight, "weekday_quantile")


def trend_weekday(history: DataFrame, horizon: int) -> DataFrame:
    """A straight line, plus the mean deviation of each weekday from it, plus its spread."""
    whole = W.partitionBy(*KEYS)
    t = F.datediff("day", "as_of").cast("double")
    fitted = (
        history.select(*KEYS, "as_of", "value", t.alias("t"), F.weekday("day").alias("wd"))
        .withColumn("slope", F.coalesce(F.regr_slope("value", "t").over(whole), F.lit(0.0)))
        .withColumn("level", F.avg("value").over(whole) - F.col("slope") * F.avg("t").over(whole))
        .withColumn("off", F.col("value") - F.col("level") - F.col("slope") * F.col("t"))
        .withColumn("effect", F.avg("off").over(W.partitionBy(*KEYS, "wd")))
    )
    per_series = fitted.groupBy(*KEYS, "as_of", "slope", "level").agg(
        F.percentile(F.col("off") - F.col("effect"), _grid()).alias("spread"),
        F.map_from_entries(F.collect_set(F.struct("wd", "effect"))).alias("effects"),
    )
    steps = per_series.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    day = F.date_add("as_of", F.col("step"))
    base = (
        F.col("level")
        + F.col("slope") * F.col("step")
        + F.coalesce(F.try_element_at("effects", F.weekday(day)), F.lit(0.0))
    )
    flight = steps.withColumn("base", base).select(
        *KEYS,
        "as_of",
        day.alias("day"),
        F.transform("spread", lambda r: F.col("base") + r).alias("q"),
    )
    return _native(flight, "trend_weekday")


def covariate_line(history: DataFrame, past: DataFrame, future: DataFrame) -> DataFrame:
    """A line on one input whose future is known, with the spread of its residuals.

    ``past``: series_id, entity, day, x. ``future``: series_id, entity, day, x for the
    days ahead. Metrics with an input are forecast; the input itself is not.
    """
    whole = W.partitionBy(*KEYS)
    joined = history.join(past, ["series_id", "entity", "day"])
    fitted = (
        joined.select(*KEYS, "as_of", "value", "x")
        .withColumn("slope", F.coalesce(F.regr_slope("value", "x").over(whole), F.lit(0.0)))
        .withColumn("level", F.avg("value").over(whole) - F.col("slope") * F.avg("x").over(whole))
    )
    per_series = fitted.groupBy(*KEYS, "as_of", "slope", "level").agg(
        F.percentile(
            F.col("value") - F.col("level") - F.col("slope") * F.col("x"), _grid()
        ).alias("spread")
    )
    ahead = future.select("series_id", "entity", "day", "x")
    base = F.col("level") + F.col("slope") * F.col("x")
    flight = per_series.join(ahead, ["series_id", "entity"]).withColumn("base", base).select(
        *KEYS,
        "as_of",
        "day",
        F.transform("spread", lambda r: F.col("base") + r).alias("q"),
    )
    return _native(flight, "covariate_line")


NATIVE: dict[str, Callable[[DataFrame, int], DataFrame]] = {
    "seasonal_naive": seasonal_naive,
    "weekday_quantile": weekday_quantile,
    "trend_weekday": trend_weekday,
}


# Which forecasters can use values known ahead. The pooled one is fitted to the data.
COVARIATES = {
    "seasonal_naive": False,
    "weekday_quantile": False,
    "trend_weekday": False,
    "covariate_line": True,
    "pooled_ridge": False,
}


# Forecasters that learn from the data they are later scored on.
FITTED = ["pooled_ridge"]


def require_inputs_usable(name: str, covariates: bool, inputs: list[str]) -> None:
    """Known-future values a model cannot use are refused, never ignored."""
    if inputs and not covariates:
        raise ValueError(f"{name} cannot use known-future values: {inputs}")


# --- forecasters brought by the user -------------------------------------------------


class Forecaster(Protocol):
    """What a user's model has to offer. It is asked for one entity at a time, all of
    that entity's metrics together, because metrics of one entity move together."""

    name: str
    quantiles: list[float]
    covariates: bool

    def forecast(
        self, past: pd.DataFrame, horizon: int, metrics: list[str], future: pd.DataFrame | None
    ) -> dict[str, list[list[float]]]:
        """``past``: one row per day, one column per metric (and input). Returns, per
        metric, ``horizon`` lists of quantile values."""


@dataclass(frozen=True)
class Loaded:
    """A forecaster whose model each Python worker loads once, when its first group comes.

    Only ``load`` travels with the tasks; it returns an object with the ``forecast`` of a
    ``Forecaster``, from a file on shared storage for instance. Workers outlive tasks and jobs:
    a model stays in its worker until ``KEPT_MODELS`` others were loaded after it. ``key``
    names the model; give it a new one when the file behind ``load`` has changed.
    """

    name: str
    quantiles: list[float]
    load: Callable[[], object]
    covariates: bool = False
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def forecast(self, past, horizon, metrics, future=None):
        return _once(self.key, self.load).forecast(past, horizon, metrics, future)


#: Models that a Python worker keeps.
KEPT_MODELS = 2


def _once(key: str, load: Callable[[], object]) -> object:
    """What ``load`` returned the first time in this process.

    This package's own globals are made anew for each task it travels with, so the models are
    kept in a module that only the process has.
    """
    models = sys.modules.setdefault("_tidecast_models", ModuleType("_tidecast_models")).__dict__
    kept = models.setdefault("kept", {})
    if key not in kept:
        kept[key] = load()
        for old in list(kept)[:-KEPT_MODELS]:
            del kept[old]
    return kept[key]


def with_plugin(
    history: DataFrame,
    forecaster: Forecaster,
    horizon: int,
    inputs: list[str] | None = None,
    future: DataFrame | None = None,
) -> DataFrame:
    """Run a user's forecaster, one task call per (series, entity, window).

    A group is one entity's calendar times its metrics. ``inputs`` names the metrics
    whose future is given in ``future`` (series_id, entity, metric, day, value); giving
    them to a forecaster that cannot use them is an error, never ignored.
    """
    inputs = inputs or []
    require_inputs_usable(forecaster.name, forecaster.covariates, inputs)
    schema = (
        "series_id string, entity string, metric string, window string, model string, "
        "as_of date, day date, quantiles array<double>, q array<double>"
    )
    keys = ["series_id", "entity", "window"]
    grid = [float(x) for x in forecaster.quantiles]
    if sorted(set(grid)) != grid or not grid or not 0 < grid[0] <= grid[-1] < 1:
        raise ValueError(f"{forecaster.name} must declare rising quantiles between 0 and 1")

    def run(past: pd.DataFrame, ahead: pd.DataFrame | None) -> pd.DataFrame:
        if past.empty:
            return pd.DataFrame(columns=FLIGHT)
        wide = past.pivot(index="day", columns="metric", values="value").sort_index()
        if wide.isna().any().any():
            raise ValueError("metrics of one entity must cover the same days")
        metrics = [m for m in wide.columns if m not in inputs]
        known = None
        if ahead is not None and not ahead.empty:
            known = ahead.pivot(index="day", columns="metric", values="value").sort_index()
            if len(known) != horizon or known.isna().any().any():
                raise ValueError("known-future values must cover the horizon")
        answer = forecaster.forecast(wide, horizon, metrics, known)
        first = past.iloc[0]
        days = [d.date() for d in pd.date_range(
            pd.Timestamp(first["as_of"]) + pd.Timedelta(days=1), periods=horizon
        )]
        out = [
            (first["series_id"], first["entity"], m, first["window"], forecaster.name,
             first["as_of"], day, grid, [float(v) for v in values])
            for m in metrics
            for day, values in zip(days, answer[m], strict=True)
        ]
        return pd.DataFrame(out, columns=["series_id", "entity", "metric", "window", "model",
                                          "as_of", "day", "quantiles", "q"])

    if future is None:
        return history.groupBy(*keys).applyInPandas(
            lambda pdf: run(pdf, None), schema=schema
        ).select(*FLIGHT)
    # The known future is a horizon of rows per entity; it rides along in the same group.
    ahead = history.select(*keys, "as_of").distinct().join(future, ["series_id", "entity"])
    both = history.select(*keys, "metric", "as_of", "day", "value").unionByName(
        ahead.select(*keys, "metric", "as_of", "day", "value")
    )

    def run_both(pdf: pd.DataFrame) -> pd.DataFrame:
        late = pdf["day"] > pdf["as_of"]
        return run(pdf[~late], pdf[late])

    return both.groupBy(*keys).applyInPandas(run_both, schema=schema).select(*FLIGHT)


# --- the contract ----------------------------------------------------------------------


def with_crossing(flight: DataFrame) -> DataFrame:
    """Add ``scale`` and ``crossing``: how far quantiles are out of order, judged against
    the size of the whole forecast of that series."""
    finite = F.filter("q", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    own = F.coalesce(F.array_max(F.transform(finite, F.abs)), F.lit(0.0))
    scale = F.max(own).over(W.partitionBy(*KEYS, "model"))
    drops = F.transform(
        F.slice("q", F.lit(2), F.greatest(F.size("q") - 1, F.lit(0))),
        lambda v, i: F.greatest(F.get("q", i) - v, F.lit(0.0)),
    )
    worst = F.coalesce(F.array_max(drops), F.lit(0.0))
    return flight.withColumn("scale", scale).withColumn(
        "crossing",
        F.when(F.col("scale") < fixed.NEGLIGIBLE_SCALE, 0.0).otherwise(worst / F.col("scale")),
    )


def contract_violations(
    flight: DataFrame, horizon: int, n_quantiles: int | None = None
) -> DataFrame:
    """``series_id, entity, metric, window, model, problem`` for unusable forecasts.

    A day must have a value for each quantile its model declares, or, in a flight without
    that column, ``n_quantiles`` of them.
    """
    wanted = F.lit(n_quantiles or len(fixed.GRID))
    if n_quantiles is None and "quantiles" in flight.columns:
        wanted = F.size("quantiles")
    bad = F.exists("q", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    per = with_crossing(flight).groupBy(*KEYS, "model").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.count_if(F.size("q") != wanted).alias("n_short"),
        F.count_if(bad).alias("n_bad"),
        F.max("crossing").alias("crossing"),
    )
    problem = (
        F.when(F.col("n_days") != horizon, F.lit("days"))
        .when(F.col("n_short") > 0, F.lit("quantiles"))
        .when(F.col("n_bad") > 0, F.lit("not finite"))
        .when(F.col("crossing") > fixed.MAX_CROSSING, F.lit("out of order"))
    )
    return per.withColumn("problem", problem).where("problem is not null").select(
        *KEYS, "model", "problem"
    )


def repaired(flight: DataFrame) -> DataFrame:
    """Sort each day's quantiles back into order; keep how far they were off."""
    return with_crossing(flight).withColumn("q", F.array_sort("q")).drop("scale")


def floored(flight: DataFrame) -> DataFrame:
    """Raise to zero what cannot be negative, judged by the metric's name."""
    counted = N.concept(F.col("metric")).isin(fixed.NON_NEGATIVE)
    counted = F.coalesce(counted, F.lit(False))
    return flight.withColumn(
        "clamped",
        F.when(counted, F.size(F.filter("q", lambda v: v < 0))).otherwise(0),
    ).withColumn(
        "q",
        F.when(counted, F.transform("q", lambda v: F.greatest(v, F.lit(0.0)))).otherwise(
            F.col("q")
        ),
    )


def repair_stats(fixed_flight: DataFrame) -> DataFrame:
    """Per run: the largest reordering and how many values were raised to zero."""
    return fixed_flight.groupBy("series_id", "window", "model").agg(
        F.max("crossing").alias("crossing"), F.sum("clamped").alias("clamped")
    )


def long_form(flight: DataFrame, quantiles: list[float] | None = None) -> DataFrame:
    """One row per quantile, as stored, on the grid the flight carries unless one is given."""
    grid = F.array(*[F.lit(q) for q in (quantiles or fixed.GRID)])
    if quantiles is None and "quantiles" in flight.columns:
        grid = F.col("quantiles")
    rest = [c for c in flight.columns if c not in ("q", "quantiles")]
    pairs = F.posexplode(F.arrays_zip(grid.alias("quantile"), F.col("q").alias("value")))
    return flight.select(*rest, pairs.alias("q_idx", "pair")).select(
        *rest, "q_idx", F.col("pair.value").alias("value"),
        F.col("pair.quantile").alias("quantile"),
    )


# --- a model fitted to each account's own data ------------------------------------------


#: What the account-fitted model looks at: weeks back, days averaged, and its penalty.
RIDGE = {"lags": [1, 2], "means": [28], "reg": 0.1}


def ridge_settings(**changed) -> dict:
    """The settings of ``pooled_ridge``, defaults filled in, as recorded with a fitted model."""
    unknown = set(changed) - set(RIDGE)
    if unknown:
        raise ValueError(f"no such settings: {sorted(unknown)}")
    out = RIDGE | changed
    if not list(out["lags"]) + list(out["means"]) or min([*out["lags"], *out["means"]]) < 1:
        raise ValueError("a fit needs lags or means of one or more")
    return {"lags": list(out["lags"]), "means": list(out["means"]), "reg": float(out["reg"])}


def pooled_ridge(history: DataFrame, horizon: int, **settings) -> DataFrame:
    """A ridge regression on weekly lags, fitted to all series of an account together.

    Each value is divided by its series' own level so that large and small series share
    coefficients. ``lags`` are weeks and ``means`` lengths in days, counted from the last day
    that is known a whole number of weeks before; every week of the horizon has a fit of its
    own. An account's fit is a row of sums; what other accounts hold makes no difference to it.
    All weeks' inputs come out of one pass over the series.
    """
    use = ridge_settings(**settings)
    width, weeks = len(use["lags"]) + len(use["means"]), math.ceil(horizon / 7)
    level = F.greatest(F.avg(F.abs("value")).over(W.partitionBy(*KEYS)), F.lit(1e-9))
    base = history.withColumn("level", level).withColumn("y", F.col("value") / F.col("level"))
    # The days ahead are rows like any other, with no value yet.
    ahead = F.sequence(F.date_add("as_of", 1), F.date_add("as_of", horizon))
    todo = base.where("day = as_of").withColumn("day", F.explode(ahead)).withColumn(
        "y", F.lit(None).cast("double")
    )
    at = W.partitionBy(*KEYS).orderBy(F.datediff("day", F.lit("1970-01-01")))

    def mean(first: int, last: int) -> Column:
        return F.avg("y").over(at.rangeBetween(-first, -last))

    def inputs(week: int) -> Column:
        back = [7 * (week + lag - 1) for lag in use["lags"]]
        return F.array(*[mean(d, d) for d in back],
                       *[mean(7 * week + n - 1, 7 * week) for n in use["means"]])

    seen = base.unionByName(todo).select(
        *KEYS, "as_of", "day", "level", "y",
        F.array(*[F.struct(F.lit(k).alias("week"), inputs(k).alias("x"))
                  for k in range(1, weeks + 1)]).alias("by_week"),
    )
    # A day ahead belongs to one week; a day of the past is a row of every week's fit.
    own = F.ceil(F.datediff("day", "as_of") / 7)
    featured = seen.select(
        *KEYS, "as_of", "day", "level", "y",
        F.explode(F.filter("by_week", lambda w: (F.col("y").isNotNull() | (w["week"] == own))
                           & F.forall(w["x"], lambda v: v.isNotNull()))).alias("w"),
    ).select(*KEYS, "as_of", "day", "level", "y", "w.week", "w.x")
    fit = ["series_id", "window", "week"]
    fits = regression.fitted(regression.moments(featured, fit, width), width, use["reg"])
    scored = featured.join(fits.select(*fit, "b", "mean_x", "mean_y"), fit).withColumn(
        "p", regression.predicted("x", width)
    )
    # Days ahead have no residual, so one aggregate gives the spread and their list.
    out = scored.groupBy(*KEYS, "as_of", "level", "week").agg(
        F.percentile(F.col("y") - F.col("p"), _grid()).alias("spread"),
        F.collect_list(F.when(F.col("y").isNull(), F.struct("day", "p"))).alias("days"),
    ).select(*KEYS, "as_of", "level", "spread", F.explode("days").alias("d")).select(
        *KEYS, "as_of", F.col("d.day").alias("day"),
        F.transform("spread", lambda r: (F.col("d.p") + r) * F.col("level")).alias("q"),
    )
    return _native(out, "pooled_ridge")


# --- windows averaged ---------------------------------------------------------------------


def average_runs(
    flight: DataFrame,
    label: str = fixed.AVERAGE_LABEL,
    quantiles: list[float] | None = None,
) -> DataFrame:
    """The mean of several runs, per entity, metric, day and quantile.

    ``flight`` holds only the member runs. Values are averaged within a quantile grid, never
    across two; of several grids that hold two runs or more, the one with most runs is kept,
    and the finest of those. With fewer than two runs on a grid there is no average. Given
    ``quantiles``, only runs on that grid count.
    """
    if "quantiles" not in flight.columns:
        grid = quantiles or fixed.GRID
        flight = flight.where(F.size("q") == len(grid)).withColumn(
            "quantiles", F.array(*[F.lit(q) for q in grid])
        )
    elif quantiles:
        flight = flight.where(F.col("quantiles") == F.array(*[F.lit(q) for q in quantiles]))
    keys = ["series_id", "entity", "metric", "as_of", "day"]
    # The number of runs on a grid is that of the whole run, so that all days agree.
    sizes = (
        flight.select("series_id", "model", "window", "quantiles").distinct()
        .groupBy("series_id", "quantiles").agg(F.count(F.lit(1)).alias("members"))
    )
    chosen = sizes.groupBy("series_id").agg(
        F.max_by("quantiles", F.struct("members", F.size("quantiles"), "quantiles")).alias(
            "quantiles"
        )
    )
    members = flight.join(chosen, ["series_id", "quantiles"], "left_semi")
    values = members.select(*keys, "quantiles", F.posexplode("q").alias("i", "value"))
    return (
        values.groupBy(*keys, "quantiles", "i")
        .agg(F.count(F.lit(1)).alias("n_runs"), F.avg("value").alias("value"))
        .where("n_runs > 1")
        .groupBy(*keys, "quantiles", "n_runs")
        .agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("pairs"))
        .select(
            "series_id", "entity", "metric",
            F.lit(label.split("@")[-1]).alias("window"),
            F.lit(label.split("@")[0]).alias("model"),
            "as_of", "day", "quantiles",
            F.transform("pairs", lambda p: p["value"]).alias("q"), "n_runs",
        )
    )


def averaged_members(flight: DataFrame, excluded_models: list[str] | None = None) -> DataFrame:
    """The runs that go into the average: the short window, or the whole history where
    that is exactly as long; never a model fitted to this data."""
    pool = flight if not excluded_models else flight.where(~F.col("model").isin(excluded_models))
    has_short = F.max((F.col("window") == fixed.AVERAGE_WINDOW).cast("int")).over(
        W.partitionBy("series_id", "entity", "metric")
    )
    wanted = F.when(F.col("has_short") == 1, F.lit(fixed.AVERAGE_WINDOW)).otherwise(F.lit("full"))
    return pool.withColumn("has_short", has_short).where(F.col("window") == wanted).drop(
        "has_short"
    )


def series_hash(history: DataFrame) -> DataFrame:
    """``series_id, window, input_hash``: a fingerprint of the numbers forecast from, as
    whole millionths.

    Each series is hashed over its own ordered days; series are combined by sums, which
    do not depend on order and need no gathering.
    """
    millionths = F.round(F.col("value") * 1e6).cast("decimal(38,0)").cast("string")
    pair = F.concat_ws("=", F.col("day").cast("string"), millionths)
    per_series = history.groupBy(*KEYS).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(pair)), "\n"), 256).alias("h")
    ).withColumn("h", F.sha2(F.concat_ws("/", "entity", "metric", "h"), 256))
    pieces = [
        F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
        for i in range(4)
    ]
    return per_series.groupBy("series_id", "window").agg(
        F.sha2(F.concat_ws("-", *[p.cast("string") for p in pieces]), 256).alias("input_hash")
    )
