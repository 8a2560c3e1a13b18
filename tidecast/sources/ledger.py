"""Which files were read: a listing of a folder against the ledger that a store keeps.

The ledger is a table of the store, so a file counts as read in the very version that holds
what it brought.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.session import landed
from tidecast.sources.exports import CSV_FILES, source_of
from tidecast.sources.files import Files
from tidecast.sources.store import Store

#: What tells an unread file without opening it.
SEEN = ["path", "length", "modified"]


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, source, length, modified of every CSV file in a folder; none is opened."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", CSV_FILES).load(folder)
    return found.select(
        "path", source_of(F.col("path")).alias("source"), "length",
        F.col("modificationTime").alias("modified"),
    )


def pending(spark: SparkSession, folder: str, store: Store, everything: bool = False) -> DataFrame:
    """The files of a folder that the ledger does not have as they are now."""
    found = listing(spark, folder)
    if not everything:
        found = found.join(store.read("files").select(*SEEN), SEEN, "left_anti")
    return landed(found, "pending")


def paths(files: DataFrame) -> list[str]:
    """Their paths, written so that no character in a name is taken for a pattern."""
    special = re.compile(r"([\\{}\[\]*?])")
    return [special.sub(r"\\\1", r["path"]) for r in files.select("path").collect()]


def digests(lines: DataFrame) -> DataFrame:
    """source, digest: of every line and its place, in one pass of sums.

    Lines are numbered along each block of a file; a sum weighted with the number tells
    lines in another order apart. Another block size gives another digest, which only means
    that a file is read once more.
    """
    def weight(seed: int):
        return F.xxhash64("text", F.lit(seed)).bitwiseAND((1 << 31) - 1).cast("decimal(20,0)")

    number = F.col("line_id").cast("decimal(20,0)")
    per = lines.groupBy("source", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min(number).alias("first"),
        *[F.sum(weight(k)).alias(f"s{k}") for k in (1, 2)],
        *[F.sum(weight(k) * number).alias(f"w{k}") for k in (1, 2)],
    )
    parts = per.select(
        "source", F.struct("block", "n", "s1", "s2", *[
            (F.col(f"w{k}") - F.col(f"s{k}") * F.col("first")).alias(f"w{k}") for k in (1, 2)
        ]).alias("part"))
    whole = F.to_json(F.array_sort(F.collect_list("part")))
    return parts.groupBy("source").agg(F.md5(whole.cast("binary")).alias("digest"))


def recorded(new: DataFrame, lines: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """The ledger's rows of new files, and the sources among them whose content is new.

    A file that was only touched, or moved away and put back, is recorded but not imported.
    """
    last = store.read("files").where("imported").groupBy("path").agg(
        F.max_by("digest", "read_at").alias("last"))
    files = new.join(digests(lines), "source", "left").join(last, "path", "left")
    same = F.col("digest").isNotNull() & F.col("last").eqNullSafe(F.col("digest"))
    files = landed(files.withColumns(
        {"imported": ~same, "read_at": F.current_timestamp()}).drop("last"), "files")
    return files, files.where("imported").select("source").distinct()


def archive(spark: SparkSession, folder: str, store: Store, to: str) -> int:
    """Move the files of a folder that the ledger has to another; how many were moved.

    A name that is taken there gets the time added, and a number if need be.
    """
    done = listing(spark, folder).join(store.read("files").select(*SEEN), SEEN, "left_semi")
    files, moved = Files(spark), 0
    files.make(to)
    for row in done.select("path").collect():
        name = row["path"].rsplit("/", 1)[-1]
        stem, dot, ending = name.rpartition(".")
        time = dt.datetime.now().strftime("%Y-%m-%d-%H%M%S")
        target, k = f"{to}/{name}", 1
        while not files.move(row["path"], target):
            target = f"{to}/{stem}-{time}{'' if k == 1 else f'-{k}'}{dot}{ending}"
            k += 1
        moved += 1
    return moved
