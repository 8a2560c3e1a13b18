"""Scoring stored forecasts against the actuals that have arrived since."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast import fixed

# Position of the quantiles the score uses, by value; literals compare exactly.
LOW, MID, HIGH = 0.1, 0.5, 0.9


def accuracy_view(forecasts: DataFrame, runs: DataFrame, series: DataFrame) -> DataFrame:
    """One row per forecast day with its actual, error and band.

    The three quantiles come out of one scan and one exchange by conditional
    aggregation, which the join with the actuals reuses. Only those quantiles and only days
    after the oldest run are read: both filters reach the files.
    """
    keys = ["series_id", "entity", "metric", "day"]

    def at(q: float):
        return F.max(F.when(F.col("quantile") == q, F.col("value")))

    info = runs.select(
        F.col("id").alias("run_id"),
        "series_id",
        "model",
        "as_of",
        F.get_json_object("model_info", "$.trained_through").alias("trained_through"),
    )
    # Dealt by series and day, the quantiles of a day meet each other and its actual.
    bands = (
        forecasts.where(F.col("quantile").isin(LOW, MID, HIGH))
        .join(info, "run_id")
        .repartition(*keys)
        .groupBy(*keys, "run_id", "model", "as_of", "trained_through")
        .agg(at(MID).alias("forecast"), at(LOW).alias("low"), at(HIGH).alias("high"))
        .where("forecast is not null")
    )
    # No forecast is of a day before the first run was made.
    since = runs.agg(F.min("as_of")).scalar()
    actuals = series.where(F.col("day") > since).select(*keys, F.col("value").alias("actual"))
    return scored(bands.join(actuals, keys, "left"))


def scored(joined: DataFrame) -> DataFrame:
    """Errors and bands of forecast days beside their actual, null where it has not come."""
    error = F.col("forecast") - F.col("actual")
    trained_on = F.coalesce(
        F.col("day") <= F.col("trained_through").try_cast("date"), F.lit(False)
    )
    return joined.select(
        "run_id",
        "series_id",
        "model",
        "as_of",
        F.datediff("day", "as_of").alias("days_ahead"),
        "entity",
        "metric",
        "day",
        "forecast",
        "actual",
        error.alias("error"),
        F.abs(error).alias("abs_error"),
        F.when(F.col("actual") != 0, F.lit(100.0) * error / F.col("actual")).alias("pct_error"),
        "low",
        "high",
        F.when(
            F.col("actual").isNotNull() & F.col("low").isNotNull(),
            F.col("actual").between(F.col("low"), F.col("high")),
        ).alias("inside_range"),
        trained_on.alias("trained_on"),
        "trained_through",
    )


def select_scores(
    view: DataFrame,
    entity: str = fixed.ACCOUNT,
    metric: str | None = None,
    series: str | None = None,
) -> DataFrame:
    picked = view.where(F.col("entity") == entity)
    if metric is not None:
        picked = picked.where(F.col("metric") == metric)
    if series is not None:
        picked = picked.where(F.col("series_id") == series)
    return picked


def summary(view: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Days scored, mean absolute and signed percentage error, share inside the band.

    Days a model was trained on and days without an actual are left out. A zero actual
    counts as a day but has no percentage error.
    """
    keys = by or ["model", "metric"]
    scored = view.where("actual is not null and not trained_on")
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.avg(F.abs("pct_error")).alias("avg_error"),
        F.avg("pct_error").alias("bias"),
        (F.avg(F.col("inside_range").cast("int")) * 100).alias("in_range"),
    )


def waiting_and_leaked(view: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many forecast days still wait for an actual, and how many are left out
    because the model had seen them."""
    return view.groupBy(*(by or [])).agg(
        F.count_if(F.col("actual").isNull() & ~F.col("trained_on")).alias("waiting"),
        F.count_if(F.col("actual").isNotNull() & F.col("trained_on")).alias("leaked"),
    )


def known_values(
    forecasts: DataFrame, runs: DataFrame, column: str, series: str | None = None
) -> DataFrame:
    """The entities or metrics that have a stored forecast; reads median rows only."""
    if column not in ("entity", "metric"):
        raise ValueError(f"only entity and metric can be listed, not {column}")
    ids = runs.select(F.col("id").alias("run_id"), "series_id")
    if series is not None:
        ids = ids.where(F.col("series_id") == series)
    return (
        forecasts.where(F.col("quantile") == MID)
        .select("run_id", column)
        .join(ids, "run_id", "left_semi")
        .select(column)
        .distinct()
    )


def require_known(
    forecasts: DataFrame, runs: DataFrame, column: str, value: str, series: str | None = None
) -> None:
    """Raise when a filter value was never forecast, naming a few that were."""
    have = known_values(forecasts, runs, column, series)
    if have.where(F.lower(column) == value.lower()).limit(1).count():
        return
    some = [r[0] for r in have.orderBy(column).limit(fixed.SHOWN_NAMES).collect()]
    if not some:
        raise ValueError("no forecasts stored yet")
    raise ValueError(f"{column} {value!r} is not one of those forecast, such as {some}")
