"""Data-quality rules. Every refusal is a row, so one job reports a whole batch.

``violations``: source, rule, rule_order, row_num, day, entity, column_name, detail, n.
There is one row per source, rule and, where the rule is about them, entity or column: the
first row or day that breaks it, and in ``n`` how many do.
``rule_order`` is the order in which a reader of a single file would meet the rules; the
first one per source is the headline. A source with any violation is left out of the
panel.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast import fixed
from tidecast.functions import names as N
from tidecast.functions.cells import trimmed
from tidecast.operators.columns import measured_distinct

# Rules in the order they are met.
RULES = [
    "not_a_csv", "too_large", "malformed", "too_few_columns", "header_not_utf8", "no_dates",
    "ragged_rows", "no_rows", "date_order_undecided", "unreadable_date", "no_fill_label",
    "interior_hole", "uneven_days", "bad_cell", "same_column_name", "nothing_to_forecast",
    "mixed_currency", "group_column", "named_account", "entity_twice", "entity_missing",
    "entity_new", "overflow", "segmented", "day_gap", "too_short", "column_not_forecastable",
    "entity_not_forecast", "future_input", "unusable_forecast",
]


def _row(
    df: DataFrame,
    rule: str,
    row_num: Column | None = None,
    day: Column | None = None,
    entity: Column | None = None,
    column_name: Column | None = None,
    detail: Column | None = None,
    n: Column | None = None,
) -> DataFrame:
    def or_null(c, kind):
        return (c if c is not None else F.lit(None)).cast(kind)

    return df.select(
        "source",
        F.lit(rule).alias("rule"),
        F.lit(RULES.index(rule)).alias("rule_order"),
        or_null(row_num, "long").alias("row_num"),
        or_null(day, "date").alias("day"),
        or_null(entity, "string").alias("entity"),
        or_null(column_name, "string").alias("column_name"),
        or_null(detail, "string").alias("detail"),
        (n if n is not None else F.lit(1)).cast("long").alias("n"),
    )


def _first_rows(df: DataFrame, rule: str, detail: Column | None = None, **columns) -> DataFrame:
    """One row per source: the first record that breaks a rule, and how many do."""
    shown = detail if detail is not None else F.lit(None).cast("string")
    more = {k: F.min_by(c, "row_num").alias(k) for k, c in columns.items()}
    per = df.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(shown, "row_num").alias("detail"), *more.values(),
        F.min("row_num").alias("row_num"),
    )
    return _row(
        per, rule, row_num=F.col("row_num"), detail=F.col("detail"), n=F.col("n"),
        **{k: F.col(k) for k in columns},
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def first_violation(violations: DataFrame) -> DataFrame:
    """The headline of each refused source."""
    return violations.groupBy("source").agg(
        F.min_by(
            F.struct("rule", "row_num", "day", "entity", "column_name", "detail", "n"),
            F.struct(
                F.col("rule_order"),
                F.coalesce("row_num", F.lit(0)),
                F.coalesce("day", F.lit("1000-01-01").cast("date")),
                F.coalesce("entity", F.lit("")),
            ),
        ).alias("v")
    ).select("source", "v.*")


def accepted(df: DataFrame, violations: DataFrame) -> DataFrame:
    """Rows of sources that broke no rule."""
    return df.join(violations.select("source").distinct(), "source", "left_anti")


# --- forecasts that cannot be used -------------------------------------------------


def unusable_forecasts(problems: DataFrame) -> DataFrame:
    """One row per source, model and problem of forecasts that break the contract."""
    per = problems.groupBy("series_id", "model", "window", "problem").agg(
        F.min("entity").alias("entity"), F.min("metric").alias("metric"),
        F.count(F.lit(1)).alias("n"),
    ).withColumnRenamed("series_id", "source")
    return _row(
        per, "unusable_forecast", entity=F.col("entity"), column_name=F.col("metric"),
        detail=F.format_string("%s@%s: %s", "model", "window", "problem"), n=F.col("n"),
    )


# --- shape of the file -------------------------------------------------------------


def not_a_csv(sniffed: DataFrame) -> DataFrame:
    return _row(sniffed, "not_a_csv", detail=F.col("kind"))


def _why_one_column(cell: Column) -> Column:
    return (
        F.when(cell.contains(";"), F.lit("semicolons"))
        .when(cell.contains("\t"), F.lit("tabs"))
        .otherwise(F.lit("title rows"))
    )


def file_shape(parsed: DataFrame) -> DataFrame:
    """Rules about records before any is understood: size, width, encoding, dates.

    Reads the facts stored beside the cells; only a record with too few columns is
    looked into.
    """
    # The width rows must have is that of the first data row; a header is not compared.
    data = ~F.col("is_header")
    per_source = parsed.groupBy("source").agg(
        F.min_by("width", F.when(data, F.col("row_num"))).alias("data_width"),
        F.count_if(data).alias("n_data"),
    )
    ragged = (
        parsed.where(data)
        .select("source", "row_num", "width")
        .join(per_source, "source")
        .where("width <> data_width")
    )
    return union_all(
        [
            _first_rows(parsed.where("too_large"), "too_large"),
            _first_rows(parsed.where("malformed"), "malformed"),
            _first_rows(
                parsed.where("width < 2"), "too_few_columns", _why_one_column(F.col("cells")[0])
            ),
            _row(parsed.where("is_header and bad_utf8"), "header_not_utf8"),
            _row(parsed.where("no_dates"), "no_dates"),
            _first_rows(
                ragged,
                "ragged_rows",
                F.format_string("%d of %d", F.col("width"), F.col("data_width")),
            ),
            _row(per_source.where("n_data = 0"), "no_rows"),
        ]
    )


# --- dates and days ----------------------------------------------------------------


def undecided_dates(order: DataFrame) -> DataFrame:
    return _row(order.where("date_order = 'undecided'"), "date_order_undecided")


def unreadable_dates(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows without a readable date, pointing at a date column that is not the first."""
    elsewhere = F.element_at(
        F.filter(
            F.transform("header", lambda h, i: F.struct(i.alias("i"), h.alias("h"))),
            lambda x: (x["i"] > 0) & F.lower(trimmed(x["h"])).isin(fixed.DATE_HEADERS),
        ),
        1,
    )["h"]
    hint = headers.where(F.size("header") > 0).select(
        "source",
        F.when(
            F.exists(
                F.slice("header", F.lit(2), F.size("header")),
                lambda h: F.lower(trimmed(h)).isin(fixed.DATE_HEADERS),
            ),
            elsewhere,
        ).alias("hint"),
    )
    bad = rows.where("day is null").join(hint, "source", "left")
    return _first_rows(bad, "unreadable_date", F.col("cells")[0], column_name=F.col("hint"))


def uneven_days(per_day: DataFrame, stats: DataFrame) -> DataFrame:
    """Days that carry another number of rows than the first day."""
    odd = (
        stats.where("min_rows <> max_rows")
        .select("source", "rows_per_day")
        .join(per_day, "source")
        .where("n_rows <> rows_per_day")
    )
    said = F.format_string("%d rows, not %d", F.col("n_rows"), F.col("rows_per_day"))
    per = odd.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(said, "day").alias("detail"),
        F.min("day").alias("day"),
    )
    return _row(
        per, "uneven_days", day=F.col("day"), detail=F.col("detail"), n=F.col("n")
    )


def day_steps(per_day: DataFrame) -> DataFrame:
    """``source, prev_day, day, step`` between consecutive days. A calendar per source."""
    prev = F.lag("day").over(W.partitionBy("source").orderBy("day"))
    return (
        per_day.select("source", "day", prev.alias("prev_day"))
        .where("prev_day is not null")
        .withColumn("step", F.datediff("day", "prev_day"))
    )


def segmentation(steps: DataFrame) -> DataFrame:
    """``source, step, period``: sources whose every step is the same and over a day."""
    per_source = steps.groupBy("source").agg(
        F.min("step").alias("step"), F.max("step").alias("most"), F.count("*").alias("n_steps")
    )
    period = (
        F.when(F.col("step") == 7, F.lit("weekly"))
        .when(F.col("step").between(28, 31), F.lit("monthly"))
        .otherwise(F.format_string("every %d days", F.col("step")))
    )
    return per_source.where("step = most and step > 1 and n_steps > 1").select(
        "source", "step", period.alias("period")
    )


def gaps(steps: DataFrame) -> DataFrame:
    """``source, prev_day, day, missing`` for every break in a daily calendar."""
    seg = segmentation(steps).select("source")
    return (
        steps.where("step > 1")
        .join(seg, "source", "left_anti")
        .select("source", "prev_day", "day", (F.col("step") - 1).alias("missing"))
    )


def calendar(per_day: DataFrame, stats: DataFrame, min_days: int = fixed.MIN_DAYS) -> DataFrame:
    steps = day_steps(per_day)
    return union_all(
        [
            _row(segmentation(steps), "segmented", detail=F.col("period")),
            _row(
                gaps(steps).groupBy("source").agg(
                    F.min_by(
                        F.format_string(
                            "%d missing after %s", F.col("missing"), F.col("prev_day").cast("string")
                        ),
                        "day",
                    ).alias("detail"),
                    F.count(F.lit(1)).alias("n"),
                    F.min("day").alias("day"),
                ),
                "day_gap",
                day=F.col("day"),
                detail=F.col("detail"),
                n=F.col("n"),
            ),
            _row(
                stats.where(F.col("n_days") < min_days),
                "too_short",
                detail=F.format_string("%d days, %d needed", F.col("n_days"), F.lit(min_days)),
            ),
        ]
    )


# --- columns -----------------------------------------------------------------------


def bad_cells(named: DataFrame) -> DataFrame:
    """A column with a few unreadable cells is a typo; with many it is a text column."""
    typo = named.where("n_bad > 0 and n_bad * 10 < n_cells")
    return _row(
        typo,
        "bad_cell",
        row_num=F.col("first_bad_row"),
        column_name=F.col("name"),
        detail=F.format_string("%d unreadable", F.col("n_bad")),
    )


def column_rules(columns: DataFrame, currencies: DataFrame) -> DataFrame:
    metrics = columns.where("role = 'metric'")
    twice = (
        metrics.groupBy("source", F.lower(trimmed(F.col("name"))).alias("folded"))
        .agg(F.count("*").alias("n"), F.max_by("name", "col_idx").alias("name"))
        .where("n > 1")
    )
    nothing = columns.groupBy("source").agg(
        F.count_if(F.col("role") == "metric").alias("n")
    ).where("n = 0")
    return union_all(
        [
            _row(twice, "same_column_name", column_name=F.col("name")),
            _row(nothing, "nothing_to_forecast"),
            _row(
                currencies.where("mixed"), "mixed_currency"
            ),
        ]
    )


def requested_columns(columns: DataFrame, wanted: list[str]) -> DataFrame:
    """Requested columns that cannot be forecast, and why."""
    asked = columns.select("source").distinct().select(
        "source", F.explode(F.array(*[F.lit(w) for w in wanted])).alias("asked")
    )
    found = asked.join(
        columns.select("source", F.lower(trimmed(F.col("name"))).alias("k"), "role"),
        (asked["source"] == columns["source"]) & (F.lower(trimmed(F.col("asked"))) == F.col("k")),
        "left",
    ).select(asked["source"], "asked", "role")
    best = found.groupBy("source", "asked").agg(
        F.bool_or(F.coalesce(F.col("role") == "metric", F.lit(False))).alias("ok"),
        F.min("role").alias("role"),
    )
    return _row(
        best.where("not ok"),
        "column_not_forecastable",
        column_name=F.col("asked"),
        detail=F.coalesce("role", F.lit("unknown")),
    )


def requested_entities(states: DataFrame, wanted: list[str]) -> DataFrame:
    """Requested entities that are excluded or unknown. ``account`` means the total."""
    names = [fixed.ACCOUNT if w.lower() == "account" else w for w in wanted]
    asked = states.select("source").distinct().select(
        "source", F.explode(F.array(*[F.lit(w) for w in names])).alias("asked")
    )
    found = asked.join(
        states.select(
            F.col("source"), F.lower("entity").alias("k"), "state", "reason"
        ).withColumnRenamed("source", "s"),
        (F.col("source") == F.col("s")) & (F.lower("asked") == F.col("k")),
        "left",
    )
    return _row(
        found.where("state is null or state <> 'live'"),
        "entity_not_forecast",
        entity=F.col("asked"),
        detail=F.coalesce("reason", F.lit("unknown")),
    )


def group_rules(
    groups: DataFrame, rows: DataFrame, columns: DataFrame, stats: DataFrame
) -> DataFrame:
    """Why a source's rows of one day cannot be told apart."""
    stuck = groups.where("verdict = 'none'").select("source")
    measured = (
        measured_distinct(rows.join(stuck, "source", "left_semi"), columns)
        .join(stats.select("source", "rows_per_day"), "source")
        .where("n_distinct = rows_per_day")
        .select("source", F.lit(True).alias("only_measures"))
        .distinct()
    )
    bad = groups.where("verdict not in ('ok', 'single')").join(measured, "source", "left")
    detail = F.when(F.col("only_measures"), F.lit("only_measures")).otherwise(F.col("verdict"))
    return _row(bad, "group_column", column_name=F.col("group_by"), detail=detail)


def no_fill_label(stats: DataFrame, fill_labels: DataFrame) -> DataFrame:
    return _row(
        stats.join(fill_labels, "source", "left_anti"), "no_fill_label"
    )


def holes(found: DataFrame) -> DataFrame:
    return _row(
        found, "interior_hole", day=F.col("day"), entity=F.col("entity"), n=F.col("n")
    )


# --- entities ----------------------------------------------------------------------


def entity_days(keyed: DataFrame) -> DataFrame:
    """``source, entity, day, n`` for sources that have a group column."""
    return (
        keyed.where("entity is not null")
        .groupBy("source", "entity", "day")
        .agg(F.count(F.lit(1)).alias("n"), F.min("row_num").alias("row_num"))
    )


def same_entities(per_entity_day: DataFrame, stats: DataFrame) -> DataFrame:
    """Every day must list the entities of the first day, each once.

    Entities are compared one by one through their own set of days, a calendar each;
    the set of all entities of a source is never gathered.
    """
    twice = per_entity_day.where("n > 1").groupBy("source", "entity").agg(
        F.min("day").alias("day"), F.count(F.lit(1)).alias("n")
    )
    days = per_entity_day.groupBy("source", "entity").agg(
        F.min("day").alias("first_seen"), F.collect_set("day").alias("seen")
    ).join(stats.select("source", "first_day", "days"), "source")
    lacking = F.array_except("days", "seen")
    missing = days.where("first_seen = first_day").select(
        "source", "entity", F.array_min(lacking).alias("day"), F.size(lacking).alias("n")
    ).where("n > 0")
    new = days.where("first_seen > first_day")
    return union_all(
        [
            _row(
                twice, "entity_twice", day=F.col("day"), entity=F.col("entity"), n=F.col("n")
            ),
            _row(
                missing, "entity_missing", day=F.col("day"), entity=F.col("entity"), n=F.col("n")
            ),
            _row(new, "entity_new", day=F.col("first_seen"), entity=F.col("entity")),
        ]
    )


def named_account(keyed: DataFrame) -> DataFrame:
    hit = keyed.where(F.col("entity") == fixed.ACCOUNT)
    return _first_rows(hit, "named_account", entity=F.col("entity"))


def overflow(panel: DataFrame) -> DataFrame:
    off = F.isnan("value") | (F.abs("value") == float("inf"))
    per = panel.where(off).groupBy("source", "entity", "metric").agg(
        F.min("day").alias("day"), F.count(F.lit(1)).alias("n")
    )
    return _row(
        per,
        "overflow",
        day=F.col("day"),
        entity=F.col("entity"),
        column_name=F.col("metric"),
        n=F.col("n"),
    )


# --- inputs known ahead --------------------------------------------------------------


def future_inputs(columns: DataFrame, future: DataFrame, horizon: int) -> DataFrame:
    """Known-future inputs that cannot be used: unknown, wrong length, or nothing left.

    ``future`` has ``source, metric, step, value``.
    """
    numeric = columns.where(F.col("role").isin("metric", "setting")).select(
        "source", F.col("name").alias("metric"), "role"
    )
    given = future.groupBy("source", "metric").agg(
        F.count("*").alias("n"), F.count_distinct("step").alias("steps")
    )
    known = given.join(numeric, ["source", "metric"], "left")
    left_over = (
        numeric.where("role = 'metric'")
        .join(given, ["source", "metric"], "left_anti")
        .select("source")
        .distinct()
    )
    nothing = given.select("source").distinct().join(left_over, "source", "left_anti")
    return union_all(
        [
            _row(
                known.where("role is null"), "future_input", column_name=F.col("metric"),
                detail=F.lit("not a numeric column"),
            ),
            _row(
                given.where("n > steps"), "future_input", column_name=F.col("metric"),
                detail=F.lit("given twice"),
            ),
            _row(
                given.where((F.col("steps") != horizon) | (F.col("n") != F.col("steps"))),
                "future_input", column_name=F.col("metric"),
                detail=F.lit("length differs from the horizon"),
            ),
            _row(nothing, "future_input", detail=F.lit("nothing left to forecast")),
        ]
    )


def check_horizon(horizon: int) -> None:
    if horizon < 1:
        raise ValueError(f"horizon must be at least 1, got {horizon}")
