"""The rows behind report pages: comparisons, totals, provenance, exclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast import fixed
from tidecast.functions.text import display_value, first_names
from tidecast.session import landed


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each model, among runs made from the newest data of a series.

    Aggregates, not windows over all runs: a series with a third of them is reduced to
    one row per model and cut-off day before anything is compared.
    """
    whole = F.struct(*runs.columns)
    per_cut = runs.groupBy("series_id", "model", "as_of").agg(
        F.max_by(whole, F.struct("created_at", "id")).alias("run")
    )
    newest = per_cut.groupBy("series_id").agg(F.max("as_of").alias("as_of"))
    return per_cut.join(newest, ["series_id", "as_of"], "left_semi").select("run.*")


def drawn_runs(latest: DataFrame, fitted: bool = False) -> DataFrame:
    """The runs a page draws: the average, plus fitted models when asked for.

    A series without a stored average falls back to every run not fitted to its data.
    """
    through = F.get_json_object("model_info", "$.trained_through")
    has_average = F.max((F.col("model") == fixed.AVERAGE_LABEL).cast("int")).over(
        W.partitionBy("series_id")
    )
    is_fitted = through.isNotNull()
    plain = F.when(F.col("has_average") == 1, F.col("model") == fixed.AVERAGE_LABEL).otherwise(
        ~is_fitted
    )
    keep = plain | is_fitted if fitted else plain & ~is_fitted
    return latest.withColumn("has_average", has_average).where(keep).drop("has_average")


def quantile_arrays(forecasts: DataFrame) -> DataFrame:
    """Stored long rows back to one array of quantiles per forecast day."""
    pairs = F.array_sort(F.collect_list(F.struct("quantile", "value")))
    return forecasts.groupBy("run_id", "entity", "metric", "day").agg(
        F.transform(pairs, lambda p: p["value"]).alias("q")
    )


def low_median_high(arrays: DataFrame) -> DataFrame:
    """First, middle and last quantile of every forecast day."""
    return arrays.withColumns(
        {
            "low": F.col("q")[0],
            "median": F.col("q")[F.floor(F.size("q") / 2).cast("int")],
            "high": F.element_at("q", -1),
        }
    ).drop("q")


def forecast_days(forecasts: DataFrame) -> DataFrame:
    return forecasts.select("run_id", "day").distinct()


def shared(items: DataFrame, runs: DataFrame) -> DataFrame:
    """Items that every compared run of a series has, with what ``in_order`` ranks them by.

    ``items``: series_id, run_id, item, one row per entity (or metric) of a run, and where
    known its ``position``. The account comes first, then what was seen first, then names.
    """
    if "position" not in items.columns:
        items = items.withColumn("position", F.lit(None).cast("bigint"))
    n_runs = runs.groupBy("series_id").agg(F.count_distinct("id").alias("n_runs"))
    per_run = items.groupBy("series_id", "run_id", "item").agg(F.min("position").alias("position"))
    found = per_run.groupBy("series_id", "item").agg(
        F.count(F.lit(1)).alias("n"), F.min("position").alias("position"))
    after = (F.col("item") != fixed.ACCOUNT).alias("after_account")
    return found.join(n_runs, "series_id").where("n = n_runs").select(
        "series_id", "item", after, "position")


def in_order(items: DataFrame) -> DataFrame:
    """``rank`` of shared items in their series: sorted in ranges, then counted across them.

    The series with most items is sorted by many tasks; a task's window holds one range.
    """
    keys = ["series_id", "after_account", F.col("position").asc_nulls_last(), "item"]
    ranged = items.repartitionByRange(*keys).withColumn("part", F.spark_partition_id())
    ranged = landed(ranged, "ranged")
    sizes = ranged.groupBy("series_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("series_id").orderBy("part").rowsBetween(
        W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("series_id", "part", before.alias("before"))
    inside = F.row_number().over(W.partitionBy("series_id", "part").orderBy(*keys[1:]))
    return ranged.join(starts, ["series_id", "part"]).withColumn(
        "rank", F.col("before") + inside).drop("before", "part")


def run_metrics(runs: DataFrame) -> DataFrame:
    return runs.select("series_id", F.col("id").alias("run_id"), F.explode("metrics").alias("item"))


def comparison(arrays: DataFrame, runs: DataFrame, run_entities: DataFrame) -> DataFrame:
    """One line per run for each (entity, metric) all runs of the series have."""
    compared = run_entities.join(
        runs.select(F.col("id").alias("run_id")), "run_id", "left_semi"
    ).withColumnRenamed("entity", "item")
    entities = shared(compared, runs).select("series_id", F.col("item").alias("entity"))
    metrics = shared(run_metrics(runs), runs).select("series_id", F.col("item").alias("metric"))
    ids = runs.select(F.col("id").alias("run_id"), "series_id", "model")
    return (
        low_median_high(arrays)
        .join(ids, "run_id")
        .join(entities, ["series_id", "entity"], "left_semi")
        .join(metrics, ["series_id", "metric"], "left_semi")
    )


def compare_pivot(lines: DataFrame, models: list[str]) -> DataFrame:
    """Forecast days as rows, one column of medians per run."""
    return (
        lines.groupBy("series_id", "entity", "metric", "day")
        .pivot("model", models)
        .agg(F.first("median"))
    )


def horizon_totals(lines: DataFrame, columns: DataFrame, display: bool = False) -> DataFrame:
    """Sum of medians over the horizon; the mean instead for rates and percentages."""
    is_rate = (
        columns.select(
            F.col("source").alias("series_id"),
            F.col("name").alias("metric"),
            (F.col("averaged") | F.col("is_percent")).alias("is_rate"),
            "is_percent",
        )
    )
    total = F.when(F.col("is_rate"), F.col("mean")).otherwise(F.col("sum"))
    out = (
        lines.groupBy("series_id", "entity", "metric", "model")
        .agg(F.sum("median").alias("sum"), F.avg("median").alias("mean"))
        .join(is_rate, ["series_id", "metric"], "left")
        .withColumn("total", total)
        .withColumn("is_rate", F.coalesce("is_rate", F.lit(False)))
    )
    if display:
        out = out.withColumn(
            "shown", display_value(F.col("total"), F.coalesce("is_percent", F.lit(False)))
        )
    return out.drop("sum", "mean", "is_percent")


def observed_totals(series: DataFrame, history_days: int) -> DataFrame:
    """What happened over the last days drawn (0 draws everything)."""
    last = F.max("day").over(W.partitionBy("series_id", "entity", "metric"))
    recent = (
        series.withColumn("last_day", last).where(F.datediff("last_day", "day") < history_days)
        if history_days > 0
        else series
    )
    return recent.groupBy("series_id", "entity", "metric").agg(
        F.sum("value").alias("observed"), F.count(F.lit(1)).alias("n_days")
    )


def provenance(runs: DataFrame) -> DataFrame:
    """What each run is: its model, cut-off if fitted, and its members if averaged."""
    info = F.col("model_info")
    return runs.select(
        "id", "series_id", "model", "as_of", "horizon", "input_hash",
        F.get_json_object(info, "$.repo").alias("repo"),
        F.get_json_object(info, "$.revision").alias("revision"),
        F.get_json_object(info, "$.weights_sha256").alias("weights"),
        F.get_json_object(info, "$.trained_through").alias("trained_through"),
        F.from_json(F.get_json_object(info, "$.averaged"), "array<string>").alias("averaged"),
    )


def exclusions(states: DataFrame) -> DataFrame:
    """Entities stored but not forecast, and why."""
    return states.where("state <> 'live'").select("source", "entity", "state", "reason")


def exclusion_lists(excluded: DataFrame) -> DataFrame:
    """Per source and reason: how many, and the first few by name.

    Names are ranked before they are listed, so a source with any number of entities
    puts at most a line's worth of them into one row.
    """
    ranked = excluded.withColumn(
        "rn",
        F.row_number().over(W.partitionBy("source", "state").orderBy("entity")),
    ).where(F.col("rn") <= fixed.SHOWN_NAMES)
    counts = excluded.groupBy("source", "state").agg(F.count(F.lit(1)).alias("n"))
    shown = ranked.groupBy("source", "state").agg(
        F.array_sort(F.collect_list("entity")).alias("names")
    )
    more = F.format_string("and %d more", F.col("n") - fixed.SHOWN_NAMES)
    return counts.join(shown, ["source", "state"]).select(
        "source", "state", "n",
        F.when(F.col("n") > fixed.SHOWN_NAMES, F.concat("names", F.array(more)))
        .otherwise(F.col("names")).alias("names"),
    )


def rate_explanations(columns: DataFrame) -> DataFrame:
    """Per rate: the column its account figure is weighted by, or that it is a plain mean."""
    return columns.where("averaged").select(
        "source", F.col("name").alias("metric"), "weighted_by",
        F.when(F.col("weighted_by").isNull(), F.lit("plain mean"))
        .otherwise(F.lit("blended")).alias("kind"),
    )


def rebuilt(
    series: DataFrame, runs: DataFrame, run_entities: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """History behind stored runs, and the stored entities no run forecast."""
    entities = run_entities.select("series_id", "entity").distinct()
    metrics = runs.select("series_id", F.explode("metrics").alias("metric")).distinct()
    history = series.join(entities, ["series_id", "entity"], "left_semi").join(
        metrics, ["series_id", "metric"], "left_semi"
    )
    idle = (
        series.join(runs.select("series_id").distinct(), "series_id", "left_semi")
        .select("series_id", "entity").distinct()
        .join(entities, ["series_id", "entity"], "left_anti")
    )
    return history, idle


def runs_without_history(runs: DataFrame, series: DataFrame) -> DataFrame:
    """Runs none of whose metrics is in the stored history of their series."""
    metrics = runs.select("id", "series_id", F.explode("metrics").alias("metric"))
    found = metrics.join(
        series.select("series_id", "metric").distinct(), ["series_id", "metric"], "left_semi"
    )
    return runs.join(found.select("id").distinct(), "id", "left_anti").select("id", "series_id")


def headline_entity(run_entities: DataFrame) -> DataFrame:
    """The account where it was forecast, else the entity that comes first: ``run_id, entity``."""
    names = run_entities.columns
    position = F.col("position") if "position" in names else F.lit(None).cast("bigint")
    order = F.struct(F.col("entity") != fixed.ACCOUNT, position.isNull(), position, F.col("entity"))
    return run_entities.groupBy("run_id").agg(F.min_by("entity", order).alias("entity"))


def axis_bounds(series: DataFrame, lines: DataFrame) -> DataFrame:
    """Lowest and highest value a chart must show; zero-based when that costs little."""
    both = series.select("series_id", "entity", "metric", "value").unionByName(
        lines.select("series_id", "entity", "metric", F.col("median").alias("value"))
    )
    lo, hi = F.col("lo"), F.col("hi")
    return (
        both.groupBy("series_id", "entity", "metric")
        .agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
        .withColumn("hi", F.when(hi <= lo, lo + 1).otherwise(hi))
        .withColumn("lo", F.when((lo > 0) & (lo < hi * 0.6), 0.0).otherwise(lo))
    )


def chart_payload(series: DataFrame, lines: DataFrame) -> DataFrame:
    """One JSON document per (entity, metric): days, actuals, and a line per run.

    A row holds one series' calendar and one horizon per run.
    """
    actual = series.groupBy("series_id", "entity", "metric").agg(
        F.array_sort(F.collect_list(F.struct("day", "value"))).alias("past")
    )
    per_run = lines.groupBy("series_id", "entity", "metric", "model").agg(
        F.array_sort(F.collect_list(F.struct("day", "median", "low", "high"))).alias("points")
    )
    ahead = per_run.groupBy("series_id", "entity", "metric").agg(
        F.array_sort(F.collect_list(F.struct("model", "points"))).alias("lines")
    )
    document = F.struct(
        F.transform("past", lambda p: p["day"]).alias("days"),
        F.transform("past", lambda p: p["value"]).alias("actual"),
        F.size("past").alias("cut"),
        F.col("lines"),
    )
    return actual.join(ahead, ["series_id", "entity", "metric"]).select(
        "series_id", "entity", "metric", F.to_json(document).alias("payload")
    )


def shown_names(names: Column) -> Column:
    return first_names(names)
