"""Walk-forward backtests: the same forecasters from many points in the past."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast import fixed


def origins_of(
    stats: DataFrame, n_origins: int | None, horizon: int, step: int = 7
) -> DataFrame:
    """``source, origin``: cut days that leave a whole horizon, ``step`` days apart.

    All of them, or the last ``n_origins`` where that many are asked for.
    """
    last = F.date_sub("last_day", horizon)
    first = F.date_add("first_day", 1)
    if n_origins is not None:
        first = F.greatest(first, F.date_sub(last, (n_origins - 1) * step))
    back = F.expr(f"make_dt_interval(-{int(step)})")
    some = stats.where(last > F.col("first_day")).select(
        "source", F.explode(F.sequence(last, first, back)).alias("origin")
    )
    return some.select("source", F.col("origin").cast("date").alias("origin"))


def history_at(inputs: DataFrame, origins: DataFrame, windows: list[tuple[str, int]]) -> DataFrame:
    """History as it stood at each origin, cut into windows.

    The origin is folded into the window label, so forecasters treat each (origin,
    window) as a series of its own: one more grouping key, no loop. Every row is
    repeated only for the origins and windows it belongs to.
    """
    plan = F.array(
        *[F.struct(F.lit(n).alias("name"), F.lit(d).alias("days")) for n, d in windows]
    )
    per_source = origins.groupBy("source").agg(F.collect_list("origin").alias("origins"))
    cut = inputs.join(per_source, "source").select(
        F.col("source").alias("series_id"),
        "entity",
        "metric",
        "concept",
        "day",
        "value",
        F.explode(F.filter("origins", lambda o: o >= F.col("day"))).alias("as_of"),
    )
    spans = F.filter(
        plan,
        lambda p: (p["days"] == 0) | (F.datediff(F.col("as_of"), F.col("day")) < p["days"]),
    )
    return (
        cut.withColumn("w", F.explode(spans))
        .withColumn("window", F.concat_ws("|", F.col("w.name"), F.col("as_of").cast("string")))
        .drop("w")
    )


def backtest(
    inputs: DataFrame,
    stats: DataFrame,
    forecasters: list[Callable[[DataFrame, int], DataFrame]],
    horizon: int = 7,
    n_origins: int | None = None,
    windows: list[tuple[str, int]] | None = None,
    step: int = 7,
) -> DataFrame:
    """``series_id, entity, metric, model, window, origin, day, forecast, actual, ...``."""
    windows = windows or [("full", 0), ("90d", 90)]
    history = history_at(inputs, origins_of(stats, n_origins, horizon, step), windows)
    flights = None
    for forecaster in forecasters:
        one = forecaster(history, horizon)
        flights = one if flights is None else flights.unionByName(one)
    actual = inputs.select(
        F.col("source").alias("series_id"), "entity", "metric", "day",
        F.col("value").alias("actual"),
    )
    mid = F.col("q")[F.floor(F.size("q") / 2).cast("int")]
    return (
        flights.join(actual, ["series_id", "entity", "metric", "day"])
        .select(
            "series_id", "entity", "metric", "model",
            F.substring_index("window", "|", 1).alias("window"),
            F.col("as_of").alias("origin"),
            F.datediff("day", "as_of").alias("days_ahead"),
            "day",
            mid.alias("forecast"),
            "actual",
            F.col("q")[0].alias("low"),
            F.element_at("q", -1).alias("high"),
        )
    )


def backtest_summary(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    keys = by or ["model", "window", "metric"]
    miss = F.col("forecast") - F.col("actual")
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.avg(F.abs(miss)).alias("mae"),
        F.avg(
            F.when(F.col("actual") != 0, F.lit(100.0) * F.abs(miss) / F.abs("actual"))
        ).alias("mape"),
        (F.avg(F.col("actual").between(F.col("low"), F.col("high")).cast("int")) * 100).alias(
            "in_range"
        ),
    )


# --- walk-forward over arrays ------------------------------------------------------------

#: The forecasters that can be walked forward without a copy of the history per origin.
WALKED = ("seasonal_naive", "weekday_quantile")
#: Origins of a series that one task takes at a time.
ORIGINS = 32


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def _quantiles(values: Column, whole: Column, grid: list[float]) -> Column:
    """Interpolated quantiles of the values that are there; nulls where none is."""
    def at(v: Column, q: float) -> Column:
        place = F.lit(q) * (F.size(v) - 1)
        low = F.floor(place).cast("int")
        rest = place - low
        return F.get(v, low) + F.when(rest > 0, rest * (F.get(v, low + 1) - F.get(v, low))).otherwise(0.0)

    held = F.when(whole, values).otherwise(F.filter(values, lambda x: x.isNotNull()))
    return _let(F.sort_array(held), lambda v: F.array(*[at(v, q) for q in grid]))


def walk_forward(
    inputs: DataFrame,
    stats: DataFrame,
    models: tuple[str, ...] = WALKED,
    horizon: int = 7,
    n_origins: int | None = None,
    windows: list[tuple[str, int]] | None = None,
    step: int = 7,
    season: int = 7,
) -> DataFrame:
    """What ``backtest`` gives for the native forecasters of ``WALKED``, without its copies.

    The days of a series become one array, bounded by its calendar, in one exchange; season's
    changes are taken from it once, and each origin and window reads slices of the two. The
    actuals are in the same array, so nothing is joined. Days that a series lacks count as
    unknown: they are in no quantile and are not scored.
    """
    windows = windows or [("full", 0), ("90d", 90)]
    spans = F.array(*[F.struct(F.lit(n).alias("window"), F.lit(d).alias("days")) for n, d in windows])
    cuts = origins_of(stats, n_origins, horizon, step).groupBy("source").agg(
        F.sort_array(F.collect_list("origin")).alias("origins"))
    points = F.array_sort(F.collect_list(F.struct("day", "value")))
    series = inputs.groupBy("source", "entity", "metric").agg(points.alias("points"))
    first, last = F.col("points")[0]["day"], F.element_at("points", -1)["day"]
    no_hole = F.size("points") == F.datediff(last, first) + 1
    known = F.map_from_entries("points")
    value = F.when(no_hole, F.transform("points", lambda p: p["value"])).otherwise(
        F.transform(F.sequence(first, last), lambda d: F.try_element_at(known, d)))
    series = series.select("source", "entity", "metric", first.alias("first"), value.alias("v"))
    n = F.size("v")
    # zip_with pads the shorter side: what has no later day has no change.
    later = F.slice("v", season + 1, F.greatest(n - season, F.lit(0)))
    changes = F.slice(F.zip_with(later, F.col("v"), lambda a, b: a - b), 1,
                      F.greatest(n - season, F.lit(0)))
    weekdays = F.array(*[F.when(n > r, F.transform(
        F.sequence(F.lit(r), F.greatest(n - 1, F.lit(r)), F.lit(7)),
        lambda i: F.get("v", i))).otherwise(F.array().cast("array<double>")) for r in range(7)])
    series = series.withColumns({
        "changes": changes, "weekdays": weekdays, "whole": ~F.exists("v", lambda x: x.isNull())})

    def origin(o: Column, w: Column) -> Column:
        """Forecasts of one origin and window: model, day, q, all steps."""
        at = F.datediff(o, F.col("first")) + 1
        end = F.least(at, F.size("v"))
        start = F.when(w["days"] == 0, 1).otherwise(F.greatest(at - w["days"] + 1, F.lit(1)))
        steps = F.sequence(F.lit(1), F.lit(horizon))
        made = []
        if "seasonal_naive" in models:
            n_changes = F.greatest(end - season - start + 1, F.lit(0))
            spread = _quantiles(F.slice("changes", start, n_changes), F.col("whole"), fixed.GRID)

            def base(s: Column) -> Column:
                back = at + s - F.ceil(s / season).cast("int") * season
                known = F.when((back >= start) & (back <= end), F.get("v", back - 1))
                newest = F.when(F.col("whole"), F.get("v", end - 1)).otherwise(F.try_element_at(
                    F.filter(F.slice("v", 1, end), lambda x: x.isNotNull()), F.lit(-1)))
                return F.coalesce(known, newest)

            made.append(_let(spread, lambda r: F.transform(steps, lambda s: F.struct(
                F.lit("seasonal_naive").alias("model"), s.alias("s"),
                _let(base(s), lambda b: F.transform(r, lambda x: b + x)).alias("q")))))
        if "weekday_quantile" in models:
            def same(s: Column) -> Column:
                """What that weekday was, from the window's start to the end."""
                day = F.pmod(at + s - 1, F.lit(7))
                skip = F.greatest(F.floor((start - 1 - day + 6) / 7), F.lit(0)).cast("int")
                until = F.floor((end - 1 - day) / 7).cast("int")
                return F.slice(F.get("weekdays", day), skip + 1, F.greatest(until - skip + 1, F.lit(0)))

            rows = F.transform(steps, lambda s: F.struct(
                F.lit("weekday_quantile").alias("model"), s.alias("s"),
                _quantiles(same(s), F.col("whole"), fixed.GRID).alias("q")))
            made.append(F.filter(rows, lambda r: r["q"][0].isNotNull()))
        return F.transform(F.concat(*made), lambda r: F.struct(
            r["model"].alias("model"), w["window"].alias("window"), o.alias("origin"),
            r["s"].alias("days_ahead"), r["q"].alias("q"),
            F.get("v", at + r["s"] - 1).alias("actual")))

    # A series is little data and much work: its origins are dealt to tasks some at a time, and
    # to as many tasks as a shuffle has, which the size of the rows would not suggest.
    held = F.filter("origins", lambda o: o >= F.col("first"))
    some = F.transform(F.sequence(F.lit(0), F.greatest(F.size(held) - 1, F.lit(0)), F.lit(ORIGINS)),
                       lambda k: F.slice(held, k + 1, ORIGINS))
    spark = inputs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = series.join(cuts, "source").withColumn("some", F.explode(some)).drop("origins").repartition(
        tasks, "source", "entity", "metric", "some")
    every = F.flatten(F.transform("some", lambda o: F.flatten(F.transform(spans, lambda w: origin(o, w)))))
    mid = F.col("r.q")[len(fixed.GRID) // 2]
    return dealt.select("source", "entity", "metric", F.explode(every).alias("r")).where(
        "r.actual is not null").select(
        F.col("source").alias("series_id"), "entity", "metric", "r.model", "r.window", "r.origin",
        "r.days_ahead", F.date_add("r.origin", F.col("r.days_ahead")).alias("day"),
        mid.alias("forecast"), "r.actual", F.col("r.q")[0].alias("low"),
        F.element_at("r.q", -1).alias("high"))
