"""Labelled rows for the classifiers: which rows a model may learn from, and a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import landed, text_of


def fold(folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; -1 for a null id."""
    text = F.col("doc_id").cast("string").cast("binary")
    return F.coalesce(F.pmod(F.crc32(text), F.lit(folds)), F.lit(-1))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int,
           per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """Texts of at most ``per_class`` labelled documents of each class, and the class sizes.

    Ids are taken in the order of a hash, never from the held-out fold. Null labels and ids
    that carry both labels are left out. The picked ids are few by construction, so they are
    broadcast and the documents are scanned once; of rows that share an id, however many, the
    text with the smallest hash is taken.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(
        "doc_id IS NOT NULL AND y IN (0, 1)").where(fold(folds) != held_out)
    usable = usable.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where(
        "y = z").select("doc_id", "y")
    usable = landed(usable, "labelled")
    sizes = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in (0, 1):
        some = usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(7)),
                                                     "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    ids = F.broadcast(landed(picked, "picked"))
    found = docs.select("doc_id", text_of().alias("text")).join(ids, "doc_id").groupBy(
        "doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return found.select("doc_id", "text", "y"), sizes


def class_weights(y, sizes: dict[int, int]):
    """Weight of each sampled row, so that the classes count as they do among all labels."""
    import numpy as np

    n = np.bincount(y, minlength=2)
    total = sum(sizes.values())
    return np.array([sizes.get(int(k), 0) / max(n[k], 1) / max(total, 1) for k in y])
