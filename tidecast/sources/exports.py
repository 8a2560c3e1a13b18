"""Reading daily exports: CSV files of any size, found in a drop folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The first bytes of files that are not CSV whatever their name says.
MAGIC = [
    ("zip", ["504B0304", "504B0506"]),
    ("pdf", ["25504446"]),
    ("utf-16", ["FFFE", "FEFF"]),
]

CSV_FILES = "[!.]*.[cC][sS][vV]"


def source_of(path: Column) -> Column:
    """The name of a file's dataset: the file's without ``.csv``.

    Another spelling of the ending stays, so that ``a.csv`` and ``a.CSV`` are two.
    """
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)[.]csv$", "")


def _located(reader_df: DataFrame) -> DataFrame:
    return reader_df.select(
        source_of(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))
        .alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("text"),
    )


def numbered(located: DataFrame) -> DataFrame:
    """Add ``line_id``, which grows along each file block as it is read."""
    return located.withColumn("line_id", F.monotonically_increasing_id())


def read_lines(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """Lines of every CSV file in a folder, or of the files named. Large ones are split."""
    return numbered(
        _located(
            spark.read.format("text")
            .option("lineSep", "\n")
            .option("pathGlobFilter", CSV_FILES)
            .load(folder)
        )
    )


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The same lines as a stream of files, each read once.

    Lines are numbered in the micro-batch, see ``numbered``.
    """
    return _located(
        spark.readStream.format("text")
        .option("lineSep", "\n")
        .option("pathGlobFilter", CSV_FILES)
        .load(folder)
    )


def magic_kinds(parsed: DataFrame) -> DataFrame:
    """``source, kind`` of files that open with the bytes of another format."""
    named = [
        F.when(F.col("opening").startswith(code), F.lit(kind))
        for kind, codes in MAGIC
        for code in codes
    ]
    return (
        parsed.where("row_num = 1")
        .select("source", F.coalesce(*named).alias("kind"))
        .where("kind is not null")
    )


def other_separators(lines: DataFrame, suspects: DataFrame) -> DataFrame:
    """``source, kind`` of files separated by tabs or semicolons rather than commas.

    Judged over every line of a source, by which of the three its lines hold most often: a
    title, a stray comma or a decimal one decides nothing. One aggregate of fixed width.
    Only ``suspects`` are read, sources with a record that did not split; usually there are
    none.
    """
    counts = lines.join(suspects, "source", "left_semi").groupBy("source").agg(
        *[F.sum(F.length("text") - F.length(F.replace(F.col("text"), F.lit(c), F.lit(""))))
          .alias(n) for n, c in (("commas", ","), ("tabs", "\t"), ("semicolons", ";"))]
    )
    kind = F.when(
        (F.col("tabs") > F.col("commas")) & (F.col("tabs") >= F.col("semicolons")), F.lit("tabs")
    ).when(F.col("semicolons") > F.col("commas"), F.lit("semicolons"))
    return counts.select("source", kind.alias("kind")).where("kind is not null")
