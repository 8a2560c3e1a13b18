"""Settling the date layout of a source once, then dating its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions.cells import (
    CONTROLS,
    day_first,
    month_first,
    plain_day,
    trimmed,
    without_controls,
)


def read_days(records: DataFrame) -> DataFrame:
    """``source, row_num, plain, dmy, mdy, cells``: the day of each row under every layout.

    Written once, it answers both ``order_of`` and ``in_order`` without a second pass over
    the export. Control characters go here, before any rule about uniqueness looks at a cell.
    """
    c = F.col("first_cell")
    # One search per row; the cells are gone through only where it finds something.
    clean = F.when(
        F.array_join("cells", "").rlike(CONTROLS), F.transform("cells", without_controls)
    ).otherwise(F.col("cells"))
    return records.withColumn("first_cell", trimmed(F.col("cells")[0])).select(
        "source",
        "row_num",
        plain_day(c).alias("plain"),
        day_first(c).alias("dmy"),
        month_first(c).alias("mdy"),
        clean.alias("cells"),
    )


def date_order(records: DataFrame) -> DataFrame:
    """``source, date_order``: plain, day, month or undecided."""
    return order_of(read_days(records))


def order_of(read: DataFrame) -> DataFrame:
    """The same from rows that ``read_days`` has read.

    One pass with map-side combination: a source of any size shuffles a handful of
    partial rows.
    """
    per_source = read.groupBy("source").agg(
        F.min_by(F.col("plain").isNotNull(), "row_num").alias("starts_plain"),
        F.bool_and(F.col("dmy").isNotNull()).alias("dmy"),
        F.bool_and(F.col("mdy").isNotNull()).alias("mdy"),
    )
    order = (
        F.when(F.col("starts_plain"), F.lit("plain"))
        .when(F.col("dmy") & F.col("mdy"), F.lit("undecided"))
        .when(F.col("dmy"), F.lit("day"))
        .when(F.col("mdy"), F.lit("month"))
        .otherwise(F.lit("plain"))
    )
    return per_source.select("source", order.alias("date_order"))


def dated_rows(records: DataFrame, order: DataFrame) -> DataFrame:
    """``source, row_num, day, cells, filled``. An unreadable date is a NULL day."""
    return in_order(read_days(records), order)


def in_order(read: DataFrame, order: DataFrame) -> DataFrame:
    """The same from rows that ``read_days`` has read."""
    day = F.coalesce(
        F.when(F.col("date_order") == "day", F.col("dmy")).when(
            F.col("date_order") == "month", F.col("mdy")
        ),
        "plain",
    )
    return read.join(order, "source").select(
        "source", "row_num", day.alias("day"), "cells", F.lit(False).alias("filled")
    )


def rows_per_day(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source", "day").agg(F.count(F.lit(1)).alias("n_rows"))


def day_stats(per_day: DataFrame) -> DataFrame:
    """One row per source: its span and how many rows a day carries."""
    return per_day.groupBy("source").agg(
        F.count("day").alias("n_days"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.min("n_rows").alias("min_rows"),
        F.max("n_rows").alias("max_rows"),
        F.min_by("n_rows", "day").alias("rows_per_day"),
        F.array_sort(F.collect_set("day")).alias("days"),
    )
