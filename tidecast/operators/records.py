"""From text lines to CSV records and cells, without a reader that holds a whole file.

A quoted cell may contain line breaks, so a record can span lines and even file blocks.
Whether a line starts a record depends only on how many quotes came before it in its
file: an even number means it does. That is a running count, taken per file block and
then carried across blocks through one small row per block. Files without such cells,
which is nearly all of them, never leave the first scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast import fixed
from tidecast.functions.cells import any_day, trimmed

#: A text beyond this cannot be one value of a row, so its record is refused by size.
_MAX_RECORD_BYTES = 1 << 30


def block_summary(lines: DataFrame) -> DataFrame:
    """One row per file block with what has to be known about the blocks before it.

    ``lines`` has ``source, block, line_id, text``; ``line_id`` grows within a block.
    """
    quotes = F.length("text") - F.length(F.replace(F.col("text"), F.lit('"'), F.lit("")))
    per_block = lines.groupBy("source", "block").agg(
        F.min("line_id").alias("first_line_id"),
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(quotes.cast("long")).alias("n_quotes"),
        F.count_if(quotes % 2 == 1).alias("n_open"),
        F.count_if(F.col("text").isin("", "\r")).alias("n_blank"),
    )
    by_file = W.partitionBy("source")
    earlier = by_file.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return per_block.select(
        "source",
        "block",
        "first_line_id",
        F.coalesce(F.sum("n_lines").over(earlier), F.lit(0)).alias("lines_before"),
        F.coalesce(F.sum("n_quotes").over(earlier), F.lit(0)).alias("quotes_before"),
        ((F.sum("n_open").over(by_file) == 0) & (F.sum("n_blank").over(by_file) == 0)).alias(
            "one_line_each"
        ),
    )


def to_records(lines: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """Assemble ``source, row_num, text, too_long`` records from lines.

    ``row_num`` counts records from 1 in file order; blank lines are not records.
    ``summary`` is ``block_summary(lines)``; given as a stored table, its size is known
    and the planner need not shuffle the lines to meet it.
    """
    if summary is None:
        summary = block_summary(lines)
    located = lines.join(summary, ["source", "block"])
    simple = located.where("one_line_each").select(
        "source",
        (F.col("lines_before") + F.col("line_id") - F.col("first_line_id") + 1).alias("row_num"),
        F.rtrim(F.col("text"), F.lit("\r")).alias("text"),
        F.lit(False).alias("too_long"),
    )

    quotes = F.length("text") - F.length(F.replace(F.col("text"), F.lit('"'), F.lit("")))
    up_to = W.partitionBy("source", "block").orderBy("line_id")
    before = up_to.rowsBetween(W.unboundedPreceding, -1)
    spread = (
        located.where(~F.col("one_line_each"))
        .withColumn(
            "inside",
            (F.col("quotes_before") + F.coalesce(F.sum(quotes).over(before), F.lit(0))) % 2 == 1,
        )
        .withColumn("starts", ~F.col("inside") & ~F.col("text").isin("", "\r"))
        .where("inside or starts")
    )
    per_block = spread.groupBy("source", "block").agg(F.count_if("starts").alias("n_starts"))
    starts_before = per_block.select(
        "source",
        "block",
        F.coalesce(
            F.sum("n_starts").over(
                W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("starts_before"),
    )
    numbered = spread.join(starts_before, ["source", "block"]).withColumn(
        "row_num",
        F.col("starts_before")
        + F.sum(F.col("starts").cast("int")).over(up_to.rowsBetween(W.unboundedPreceding, 0)),
    )
    sizes = numbered.groupBy("source", "row_num").agg(
        F.sum(F.octet_length("text").cast("long")).alias("n_bytes")
    )
    # An open quote can make a record of the rest of a file. What no row can hold is
    # refused by size and its text never gathered.
    kept = numbered.join(sizes, ["source", "row_num"]).withColumn(
        "text", F.when(F.col("n_bytes") <= _MAX_RECORD_BYTES, F.col("text"))
    )
    joined = kept.groupBy("source", "row_num").agg(
        F.array_sort(
            F.collect_list(
                F.when(F.col("text").isNotNull(), F.struct("block", "line_id", "text"))
            )
        ).alias("parts"),
        F.max("n_bytes").alias("n_bytes"),
    )
    text = F.array_join(F.transform("parts", lambda p: F.rtrim(p["text"], F.lit("\r"))), "\n")
    assembled = joined.select(
        "source", "row_num", text.alias("text"),
        (F.col("n_bytes") > _MAX_RECORD_BYTES).alias("too_long"),
    )
    return simple.unionByName(assembled)


def split_cells(text: Column) -> Column:
    """Cells of one record as written, quotes still on them.

    Text between quotes sits at the odd places of a split on the quote character; commas
    there are masked before the record is split on commas. Linear in the record's length.
    """
    masked = F.array_join(
        F.transform(
            F.split(F.replace(text, F.lit("\x00"), F.lit("")), '"', -1),
            lambda p, i: F.when(i % 2 == 1, F.replace(p, F.lit(","), F.lit("\x00"))).otherwise(p),
        ),
        '"',
    )
    return F.transform(
        F.split(masked, ",", -1),
        lambda c: F.ltrim(F.replace(c, F.lit("\x00"), F.lit(",")), F.lit(fixed.SPACES)),
    )


def _quoted(c: Column) -> Column:
    return c.startswith('"')


def _well_formed(c: Column) -> Column:
    inner = F.substr(c, F.lit(2), F.length(c) - 2)
    no_lone_quote = ~F.replace(inner, F.lit('""'), F.lit("")).contains('"')
    closed = (F.length(c) >= 2) & c.endswith('"') & no_lone_quote
    return F.when(_quoted(c), closed).otherwise(~c.contains('"'))


def _unquoted(c: Column) -> Column:
    inner = F.substr(c, F.lit(2), F.length(c) - 2)
    return F.when(_quoted(c), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(c)


def parse_records(
    records: DataFrame, max_columns: int | None = None, max_cell_bytes: int | None = None
) -> DataFrame:
    """Cells of assembled records, and the facts about each that rules ask for later.

    Records past ``max_columns`` or ``max_cell_bytes``, where given, are marked too large.

    ``source, row_num, cells, width, is_header, malformed, bad_utf8, too_large, no_dates,
    opening``. The facts are columns of their own, so that rules read them without
    reading cells. Whether the bytes are UTF-8 is asked before any text function
    touches them.
    """
    text = F.when(
        F.col("row_num") == 1, F.regexp_replace("text", "^\\x{FEFF}", "")
    ).otherwise(F.col("text"))
    first = F.col("row_num") == 1
    large = F.col("too_long")
    if max_cell_bytes is not None:
        large = large | F.exists("cells", lambda c: F.octet_length(c) > max_cell_bytes)
    if max_columns is not None:
        large = large | (F.col("width") > max_columns)
    return (
        records.withColumn("written", split_cells(text))
        .withColumn("cells", F.transform("written", _unquoted))
        .withColumn("width", F.size("cells"))
        .select(
            "source",
            "row_num",
            "cells",
            "width",
            (first & ~any_day(trimmed(F.col("cells")[0]))).alias("is_header"),
            F.exists("written", lambda c: ~_well_formed(c)).alias("malformed"),
            (first & ~F.is_valid_utf8("text")).alias("bad_utf8"),
            large.alias("too_large"),
            F.when(
                F.col("row_num") == 2, ~F.exists("cells", lambda c: any_day(trimmed(c)))
            ).alias("no_dates"),
            F.when(first, F.hex(F.substring(F.col("text").cast("binary"), 1, 4))).alias(
                "opening"
            ),
        )
    )


def headers_of(parsed: DataFrame) -> DataFrame:
    """``source, header``: the first record, where it is not already data."""
    return parsed.where("row_num = 1 and is_header").select(
        "source", F.col("cells").alias("header")
    )


def data_rows(parsed: DataFrame) -> DataFrame:
    """Records that are not the header."""
    return parsed.where("not is_header").select("source", "row_num", "cells")
