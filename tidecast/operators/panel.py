"""From rows of an export to one daily series per entity, plus the account total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast import fixed
from tidecast.functions import names as N
from tidecast.functions.cells import (
    day_first,
    month_first,
    number,
    plain_day,
    trimmed,
    with_numbers,
)

STORED_ROLES = ["metric", "setting"]


def entity_key(idx: Column) -> Column:
    return trimmed(F.element_at("cells", idx + 1))


def entity_spans(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """First and last day of every entity and the days in between that it has."""
    keyed = rows.join(labels, "source").withColumn("entity", entity_key(F.col("label_idx")))
    return keyed.groupBy("source", "entity").agg(
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.collect_set("day").alias("seen"),
        F.min("row_num").alias("first_row"),
        F.max("label_idx").alias("label_idx"),
    )


def interior_holes(spans: DataFrame, stats: DataFrame) -> DataFrame:
    """Entities with days missing from inside their own run: a gap in the data, never filled.

    ``day`` is the first one missing, ``n`` how many are.
    """
    inside = F.filter(
        "days", lambda d: (d > F.col("first_day")) & (d < F.col("last_day"))
    )
    lacking = F.array_except(inside, "seen")
    return (
        spans.join(stats.select("source", "days"), "source")
        .select(
            "source", "entity", "first_day", "last_day", F.array_min(lacking).alias("day"),
            F.size(lacking).alias("n"),
        )
        .where("n > 0")
    )


def stopped_entities(spans: DataFrame, stats: DataFrame) -> DataFrame:
    """Entities whose rows end before the source does."""
    return (
        spans.select("source", "entity", "last_day")
        .join(stats.select("source", F.col("last_day").alias("source_last")), "source")
        .where("last_day < source_last")
        .select("source", "entity", "last_day")
    )


def fill_absent(
    rows: DataFrame,
    spans: DataFrame,
    stats: DataFrame,
    named: DataFrame,
    order: DataFrame,
) -> DataFrame:
    """Add a zero row for each day of the source outside an entity's own run.

    Only the days actually missing are generated, out of the source's calendar. Numbers
    become 0, a second date follows the day, labels stay as they are.
    """
    ids = named.groupBy("source").agg(
        F.collect_list(F.when(N.is_identifier(F.col("name")), F.col("col_idx"))).alias("id_idx")
    )
    absent = (
        spans.join(stats.select("source", "days"), "source")
        .select(
            "source",
            "label_idx",
            F.col("first_row").alias("row_num"),
            F.filter(
                "days", lambda d: (d < F.col("first_day")) | (d > F.col("last_day"))
            ).alias("absent"),
        )
        .where(F.size("absent") > 0)
    )
    # The entity's first row is the pattern for its missing ones, fetched by row number.
    missing = (
        rows.select("source", "row_num", F.col("cells").alias("template"))
        .join(absent, ["source", "row_num"])
        .join(ids, "source")
        .join(order, "source")
        .withColumn("day", F.explode("absent"))
    )

    def blank(cell: Column, i: Column) -> Column:
        day_text = F.col("day").cast("string")
        bare = trimmed(cell)
        dated = (
            F.when(F.col("date_order") == "day", day_first(bare))
            .when(F.col("date_order") == "month", month_first(bare))
            .otherwise(plain_day(bare))
            .isNotNull()
        )
        kept = (i == F.col("label_idx")) | F.array_contains("id_idx", i)
        return (
            F.when(i == 0, day_text)
            .when(kept, cell)
            .when(dated, day_text)
            .when(number(cell).isNotNull(), F.lit("0"))
            .otherwise(cell)
        )

    added = missing.select(
        "source",
        F.lit(-1).cast("long").alias("row_num"),
        "day",
        F.transform("template", blank).alias("cells"),
        F.lit(True).alias("filled"),
    )
    return rows.unionByName(added)


def keyed_rows(rows: DataFrame, groups: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Attach ``entity`` to rows: the label, else the group value, NULL without a group."""
    key = entity_key(F.col("group_idx"))
    keyed = rows.join(groups.select("source", "group_idx"), "source").withColumn("key", key)
    if labels is not None:
        keyed = keyed.join(labels.select("source", "key", "label"), ["source", "key"], "left")
    else:
        keyed = keyed.withColumn("label", F.lit(None).cast("string"))
    named = F.coalesce("label", "key")
    return keyed.withColumn(
        "entity",
        F.when(F.col("group_idx").isNotNull(), F.when(named == "", fixed.UNNAMED).otherwise(named)),
    ).drop("key", "label", "group_idx")


def entity_positions(keyed: DataFrame) -> DataFrame:
    """``source, entity, position``: the record at which each entity is first seen."""
    return keyed.where("entity is not null and not filled").groupBy("source", "entity").agg(
        F.min("row_num").alias("position")
    )


def build_panel(keyed: DataFrame, columns: DataFrame) -> DataFrame:
    """``source, entity, metric, day, value``: every entity and the account total.

    One scan and one exchange: entity and account rows come out of the same grouping
    sets aggregate, combined on the map side. A rate is blended on the account by its
    weight column, found in the same row, so nothing is joined back.
    """
    usable = columns.where(F.col("role").isin(STORED_ROLES)).groupBy("source").agg(
        F.collect_list(
            F.struct("col_idx", "name", "averaged", "weight_idx")
        ).alias("usable")
    )
    # Only the cells that are read leave the record.
    pairs = F.transform(
        "usable",
        lambda u: F.struct(
            u["name"].alias("name"), u["averaged"].alias("averaged"),
            u["weight_idx"].alias("weight_idx"),
            F.element_at("cells", u["col_idx"] + 1).alias("v"),
            F.element_at("cells", u["weight_idx"] + 1).alias("by"),
        ),
    )
    cells = keyed.join(usable, "source").select(
        "source", "day", "entity", "filled", F.explode(pairs).alias("u")
    )
    read = with_numbers(cells, {"v": F.col("u.v"), "by": F.col("u.by")})
    plain = F.when(F.col("filled") | F.col("v_no_data"), 0.0).otherwise(1.0)
    weight = F.when(F.col("u.weight_idx").isNotNull(), F.col("by")).otherwise(plain)
    measured = read.select(
        "source",
        "day",
        "entity",
        F.col("u.name").alias("metric"),
        F.col("u.averaged").alias("averaged"),
        "v",
        F.when(F.col("u.averaged"), weight).alias("w"),
    )
    sums = measured.groupingSets(
        [("source", "day", "metric", "entity"), ("source", "day", "metric")],
        "source",
        "day",
        "metric",
        "entity",
    ).agg(
        F.grouping("entity").alias("total"),
        F.bool_or("averaged").alias("averaged"),
        F.sum("v").alias("sum_v"),
        F.sum(F.col("v") * F.col("w")).alias("num"),
        F.sum("w").alias("den"),
    )
    blended = F.coalesce(F.try_divide(F.col("num"), F.col("den")), F.lit(0.0))
    is_total = F.col("total") == 1
    return sums.where(is_total | F.col("entity").isNotNull()).select(
        "source",
        F.when(is_total, F.lit(fixed.ACCOUNT)).otherwise(F.col("entity")).alias("entity"),
        "metric",
        "day",
        F.when(is_total & F.col("averaged"), blended).otherwise(F.col("sum_v")).alias("value"),
    )


def flat_entities(panel: DataFrame, columns: DataFrame) -> DataFrame:
    """Entities none of whose forecast metrics ever moves: ``source, entity``."""
    forecast = columns.where("role = 'metric'").select("source", F.col("name").alias("metric"))
    return (
        panel.join(forecast, ["source", "metric"], "left_semi")
        .groupBy("source", "entity", "metric")
        .agg((F.min("value") == F.max("value")).alias("still"))
        .groupBy("source", "entity")
        .agg(F.bool_and("still").alias("still"))
        .where("still")
        .select("source", "entity")
    )


def with_status(keyed: DataFrame, status: DataFrame) -> DataFrame:
    """Add ``status``, what a source's status column says, NULL where it has none."""
    said = F.lower(trimmed(F.element_at("cells", F.col("status_idx") + 1)))
    return keyed.join(status, "source", "left").withColumn("status", said).drop("status_idx")


def running_entities(keyed: DataFrame, stats: DataFrame) -> DataFrame:
    """Entities the export says are switched on as of its last day: ``source, entity``.

    Rows that were filled in are not part of what the export said.
    """
    on = keyed.where(~F.col("filled") & F.col("status").isin(fixed.STATES_ON))
    return (
        on.select("source", "entity", "day")
        .join(stats.select("source", F.col("last_day").alias("day")), ["source", "day"])
        .select("source", "entity")
        .distinct()
    )


def entity_states(
    panel: DataFrame,
    columns: DataFrame,
    running: DataFrame,
    status: DataFrame,
    stopped: DataFrame | None = None,
) -> DataFrame:
    """``source, entity, state, reason``: live, stopped, paused or flat.

    Everything is stored; only live entities and the account are forecast.
    """
    entities = panel.select("source", "entity").distinct()
    marked = (
        entities.join(running.withColumn("on", F.lit(True)), ["source", "entity"], "left")
        .join(status.select("source", F.lit(True).alias("has_status")), "source", "left")
        .join(
            flat_entities(panel, columns).withColumn("flat", F.lit(True)),
            ["source", "entity"],
            "left",
        )
    )
    if stopped is not None:
        marked = marked.join(
            stopped.select("source", "entity", F.lit(True).alias("stopped")).distinct(),
            ["source", "entity"],
            "left",
        )
    else:
        marked = marked.withColumn("stopped", F.lit(None).cast("boolean"))
    state = (
        F.when(F.col("entity") == fixed.ACCOUNT, F.lit("live"))
        .when(F.col("stopped"), F.lit("stopped"))
        .when(F.col("has_status") & F.col("on").isNull(), F.lit("paused"))
        .when(F.col("flat"), F.lit("flat"))
        .otherwise(F.lit("live"))
    )
    reason = (
        F.when(F.col("state") == "paused", F.lit("switched off in the export"))
        .when(F.col("state") == "stopped", F.lit("not listed up to the last day"))
        .when(F.col("state") == "flat", F.lit("nothing it records moved"))
    )
    return marked.withColumn("state", state).select(
        "source", "entity", "state", reason.alias("reason")
    )


def last_days(panel: DataFrame, n: int) -> DataFrame:
    """The last ``n`` days of every series of a source (0 keeps everything)."""
    if n <= 0:
        return panel
    last = F.max("day").over(W.partitionBy("source", "entity", "metric"))
    return (
        panel.withColumn("last_day", last)
        .where(F.datediff("last_day", "day") < n)
        .drop("last_day")
    )


def window_plan(stats: DataFrame) -> DataFrame:
    """``source, window, window_days, n_days, as_of``: the history windows a source can fill.

    A window longer than the history, or as long as it, is left out.
    """
    windows = F.array(
        *[
            F.struct(F.lit(label).alias("window"), F.lit(days).alias("window_days"))
            for label, days in fixed.WINDOWS
        ]
    )
    return (
        stats.select(
            "source", "n_days", F.col("last_day").alias("as_of"), F.explode(windows).alias("p")
        )
        .where("p.window_days < n_days")
        .select("source", "p.window", "p.window_days", "n_days", "as_of")
    )


def forecast_input(panel: DataFrame, columns: DataFrame, states: DataFrame) -> DataFrame:
    """The panel rows a forecaster is shown: live entities and forecast metrics."""
    metrics = columns.where("role = 'metric'").select(
        "source", F.col("name").alias("metric"), "concept", "averaged", "is_percent"
    )
    live = states.where("state = 'live'").select("source", "entity")
    return panel.join(metrics, ["source", "metric"]).join(live, ["source", "entity"], "left_semi")
