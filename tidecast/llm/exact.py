"""Exact duplicates: grouped by a 128-bit content hash, told apart by their bytes.

The group key is the hash followed by the text itself, so Spark compares the bytes of equal
hashes; a collision makes two groups. Equal texts are combined before the one shuffle of
texts, so a group of copies, however large, sends one row per task. Rows then find their
group by two digests, which no text travels for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import column, row_order, text_of


def _digests(text):
    data = text.cast("binary")
    return F.unhex(F.md5(data)).alias("hash"), F.unhex(F.sha2(data, 256)).alias("sha")


def groups(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """A row per distinct text: hash, sha, keep_id, group_size."""
    best = {"largest": F.max, "smallest": F.min}[keep]
    text = text_of()
    found = docs.select("doc_id", F.unhex(F.md5(text.cast("binary"))).alias("hash"),
                        text.alias("text"))
    found = found.groupBy("hash", "text").agg(best("doc_id").alias("keep_id"),
                                              F.count("*").alias("group_size"))
    sha = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha")
    return found.select("hash", sha, "keep_id", "group_size")


def exact_duplicates(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """Of every row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. One row of each group stays: the one with the largest (or
    smallest) doc_id; of rows that repeat both id and text, one. A null id stays only where
    its group has no other. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", *_digests(text_of())).groupBy("doc_id", "hash", "sha").agg(
        F.count("*").alias("copies"))
    joined = rows.join(groups(docs, keep), ["hash", "sha"])
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    return joined.select("doc_id", "keep_id", "group_size", "sha", copy).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def one_of_each(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The row that stays of each group of equal texts, with all its columns.

    One shuffle: the group carries the other columns of the row that stays along.
    """
    best = {"largest": F.max_by, "smallest": F.min_by}[keep]
    names, at = docs.columns, docs.columns.index("text")
    absent = F.col("doc_id").isNotNull() if keep == "largest" else F.col("doc_id").isNull()
    fields = [column(n).alias(f"c{i}") for i, n in enumerate(names) if i != at]
    rows = docs.select(text_of().alias("text"), absent.alias("absent"), "doc_id",
                       F.struct(*fields, F.col("text").isNull().alias("none")).alias("row"))
    order = F.struct("absent", "doc_id", row_order(docs, without="text"))
    found = rows.groupBy(F.md5(F.col("text").cast("binary")).alias("hash"), "text").agg(
        best("row", order).alias("row"))
    text = F.when(~F.col("row.none"), F.col("text")).alias("text")
    return found.select(*[text if i == at else F.col(f"row.c{i}").alias(n)
                          for i, n in enumerate(names)])
