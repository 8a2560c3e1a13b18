"""Benchmark decontamination: short test items found inside long documents.

Items are partitioned by size. In each partition an item keeps the ``k`` smallest of its
MinHash values, with ``k`` one more than the shingles that an item of the partition's upper
size may lack at the threshold: an item contained to the threshold cannot lack all of them,
so the search loses nothing, however long the document. Documents whose shingles meet a
sketch are verified by exact containment of shingle strings.

Everything is DataFrame functions. A document's words are hashed once; shingle hashes are
computed from them while the rows stream through the join with the sketches, which Spark
broadcasts while they are below its threshold and shuffles by hash beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidecast.llm.common import ascii_lower, key_of, key_struct, landed, packed, text_of, unpacked

SHINGLE_WORDS = 5
THRESHOLD = 0.8
_WHITE = "' \\t\\n\\u000B\\u000C\\r'"


def _words(text: Column) -> Column:
    """Array of words, empty where the text has none."""
    bare = F.btrim(ascii_lower(text), F.expr(_WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, "[\\x20\\x09-\\x0D]+"))


def _shingled(rows: DataFrame, keys: list[str], n: int, keep_words: bool = False) -> DataFrame:
    """A row per shingle: the keys, ``h`` and, if asked for, ``shingle_words``.

    Fewer words than a shingle has are one shingle; no word is none. Hashing passes over a
    null, so ``get`` beyond the last word leaves the hash of the words there are.
    """
    worded = rows.select(*keys, _words(text_of()).alias("w"))
    hashed = worded.select(*keys, *(["w"] if keep_words else []),
                           F.transform("w", lambda x: F.xxhash64(x)).alias("wh"))
    last = F.greatest(F.size("wh") - n, F.lit(0))
    at = F.explode(F.when(F.size("wh") > 0, F.sequence(F.lit(0), last))).alias("i")
    placed = hashed.select(*keys, *(["w"] if keep_words else []), "wh", at)
    h = F.xxhash64(*[F.get("wh", F.col("i") + k) for k in range(n)]).alias("h")
    return placed.select(*keys, *(["w", "i"] if keep_words else []), h)


def _string(n: int) -> Column:
    return F.array_join(F.slice("w", F.col("i") + 1, F.lit(n)), " ").alias("shingle")


def _items(items: DataFrame) -> DataFrame:
    return items.select("item_id", key_of(text_of()).alias("item_key"), text_of().alias("text"))


def item_shingles(items: DataFrame, n: int = SHINGLE_WORDS) -> DataFrame:
    """item_id, item_key, h, shingle: each distinct shingle of each item once."""
    rows = _shingled(_items(items), ["item_id", "item_key"], n, keep_words=True)
    return rows.select("item_id", "item_key", "h", _string(n)).distinct()


def _lacking(size: Column, threshold: float) -> Column:
    """Shingles that an item of this size may lack and still be contained."""
    return size - F.ceil(size * F.lit(threshold) - F.lit(1e-9))


def sketches(shingles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Of each item its smallest MinHash values, as many as its size partition needs."""
    one = W.partitionBy("item_id", "item_key")
    sized = shingles.select("item_id", "item_key", "h").distinct().withColumn(
        "n", F.count("*").over(one)).withColumn(
        "rank", F.row_number().over(one.orderBy(F.xxhash64("h", F.lit(1)), "h")))
    upper = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1
    return sized.where(F.col("rank") <= _lacking(upper, threshold) + 1).select(
        "item_id", "item_key", "h")


def contaminated(docs: DataFrame, items: DataFrame, n: int = SHINGLE_WORDS,
                 threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of a document and an item that it contains to the threshold.

    doc_id, text_key, item_id, item_key, n_shingles (the item's), n_found, containment.
    Null and empty texts, of documents or items, meet nothing. An item of fewer words than
    a shingle is contained only in a text that consists of just these words. Repeated
    document or item rows count once.
    """
    shingles = landed(item_shingles(items, n), "item-shingles")
    marks = landed(sketches(shingles, threshold), "sketches")
    keyed = docs.select("doc_id", key_of(text_of()).alias("text_key"), text_of().alias("text"))
    probes = _shingled(keyed, ["doc_id", "text_key"], n)
    near = probes.join(marks.select("h").distinct(), "h", "left_semi")
    near = landed(near.select("doc_id", "text_key").distinct(), "candidates")

    one = near.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    on = keyed["doc_id"].eqNullSafe(one["__id"]) & (keyed["text_key"] == one["__key"])
    rows = _shingled(keyed.join(one, on, "left_semi"), ["doc_id", "text_key"], n, keep_words=True)
    hits = rows.join(landed(shingles.select("h").distinct(), "item-hashes"), "h", "left_semi")
    hits = hits.select("doc_id", "text_key", "h", _string(n)).distinct()
    size = shingles.groupBy("item_id", "item_key").agg(F.count("*").alias("n_shingles"))
    found = hits.join(shingles, ["h", "shingle"]).groupBy(
        "doc_id", "text_key", "item_id", "item_key").agg(F.count("*").alias("n_found"))
    size = size.select(F.col("item_id").alias("__item"), F.col("item_key").alias("__item_key"),
                       "n_shingles")
    same = found["item_id"].eqNullSafe(size["__item"]) & (found["item_key"] == size["__item_key"])
    share = F.col("n_found") / F.col("n_shingles")
    return found.join(size, same).where(
        F.col("n_found") >= F.col("n_shingles") - _lacking(F.col("n_shingles"), threshold)).select(
        "doc_id", "text_key", "item_id", "item_key", "n_shingles", "n_found",
        share.alias("containment"))


def clean_documents(docs: DataFrame, items: DataFrame, n: int = SHINGLE_WORDS,
                    threshold: float = THRESHOLD) -> DataFrame:
    """The rows that contain no item, all their columns as they were."""
    found = contaminated(docs, items, n, threshold).select(key_struct("doc_id", "text_key"))
    found = landed(found.distinct(), "leaks")
    return unpacked(packed(docs).join(found, "key", "left_anti"), docs.columns)
