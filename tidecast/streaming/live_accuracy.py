"""Forecasts scored as actuals arrive on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.operators.accuracy import HIGH, LOW, MID, accuracy_view, scored
from tidecast.session import landed


def score_arrivals(actuals: DataFrame, forecasts: DataFrame, runs: DataFrame) -> DataFrame:
    """Accuracy rows for actuals of a stream: series_id, entity, metric, day, value.

    The bands of the stored forecasts are worked out once, before the stream starts.

    A stream-static inner join without state: a forecast row is emitted in the
    micro-batch its actual arrives in.
    """
    bands = accuracy_view(forecasts, runs, _no_actuals(actuals)).select(
        "run_id", "series_id", "model", "as_of", "days_ahead", "entity", "metric", "day",
        "forecast", "low", "high", "trained_on",
    )
    view = landed(bands, "bands")
    joined = actuals.withColumnRenamed("value", "actual").join(
        view, ["series_id", "entity", "metric", "day"]
    )
    return joined.selectExpr(
        "*",
        "forecast - actual as error",
        "case when actual <> 0 then 100D * (forecast - actual) / actual end as pct_error",
        "actual between low and high as inside_range",
    )


def forecast_days(forecasts: DataFrame, runs: DataFrame) -> DataFrame:
    """Stored forecasts as ``score_streams`` takes them: a row per run, entity, metric and day,
    with its quantiles and their values as arrays."""
    grid = F.array_sort(F.collect_list(F.struct("quantile", "value")))
    info = runs.select(
        F.col("id").alias("run_id"), "series_id", "model", "as_of",
        F.get_json_object("model_info", "$.trained_through").alias("trained_through"),
    )
    days = forecasts.groupBy("run_id", "entity", "metric", "day").agg(grid.alias("g"))
    return days.join(info, "run_id").select(
        "run_id", "series_id", "model", "as_of", "trained_through", "entity", "metric", "day",
        F.col("g.quantile").alias("quantiles"), F.col("g.value").alias("q"),
    )


def score_streams(forecasts: DataFrame, actuals: DataFrame, wait: str) -> DataFrame:
    """The accuracy view of two streams, with runs that are made while it is running.

    ``forecasts``: rows of ``forecast_days``; ``actuals``: series_id, entity, metric, day,
    value. A forecast day comes out once with its actual, as soon as both are there, or without
    one (waiting) when the streams have moved on to ``wait`` past it. Both sides are kept until
    then, so the state holds a horizon and ``wait`` of days, however long the history. What
    arrives later than ``wait`` behind the slower stream is left out here, and Spark counts it
    as dropped by the watermark; the view over the store has it. A day without the median is no
    forecast; nulls in the key match nothing.
    """
    def at(q: float) -> Column:
        found = F.array_position("quantiles", F.lit(q)).cast("int")
        return F.when(found > 0, F.get("q", found - 1))

    ahead = forecasts.select(
        "run_id", "series_id", "model", "as_of", "trained_through", "entity", "metric", "day",
        at(MID).alias("forecast"), at(LOW).alias("low"), at(HIGH).alias("high"),
        F.col("day").cast("timestamp").alias("due"),
    ).where("forecast is not null").withWatermark("due", wait)
    came = actuals.select(
        F.col("series_id").alias("of_series"), F.col("entity").alias("of_entity"),
        F.col("metric").alias("of_metric"), F.col("value").alias("actual"),
        F.col("day").cast("timestamp").alias("seen"),
    ).withWatermark("seen", wait)
    same = F.expr("series_id = of_series and entity = of_entity and metric = of_metric "
                  "and due = seen")
    return scored(ahead.join(came, same, "leftOuter"))


def _no_actuals(actuals: DataFrame) -> DataFrame:
    spark = actuals.sparkSession
    return spark.createDataFrame(
        [], "series_id string, entity string, metric string, day date, value double"
    )
