"""Mixing sources to target weights by systematic sampling.

Sources share a budget of words by weight; a target stops at a multiple of its source's
words and the excess is shared again by weight. A document of a source is expected
target / source words times. Along the documents of the source, ordered by size, these
expected copies are summed, one random offset is added, and a document is emitted once for
each whole number that the sum crosses at it. Ordered by size, what is taken misses the
target by less than the largest document.

No task holds a source: documents are ranked inside (source, size, cell), where a cell has
about ``cell_rows`` documents by a hash of id and text, and the counts of cells and sizes are summed above them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidecast.llm.common import (key_of, key_struct, landed, n_words, packed, row_order, spare,
                                 text_of, unpacked)

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
CELL_ROWS = 10_000
#: Offsets drawn for each source; the one that comes nearest the target is used.
DRAWS = 32
_GOLDEN = 0.6180339887498949


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST):
    """(source, source_size) with ``weight`` and ``target``.

    Sources by code point, null last, take the weights in turn. Sharing the excess again
    until no target is above its limit ends at target = min(limit, level x weight); the
    level follows from sums along the sources in the order in which they reach their limits.
    One narrow row per source is ordered here, no document.
    """
    order = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(most))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", limit).withColumn(
        "reach", F.col("cap") / F.col("weight"))
    full = W.orderBy("reach", F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = full.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(1))
    total = F.lit(float(share)) * F.sum("source_size").over(whole)
    ranked = ranked.withColumn("total", total).withColumn(
        "capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn(
        "left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", (F.col("total") - F.col("capped")) / F.col("left"))
    below = F.when(F.col("level") <= F.col("reach"), F.col("level"))
    level = F.max(below).over(whole)
    target = F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def _draw(seed: str, k: int):
    """The k-th offset of a source, in [0, 1): spread evenly from one random start."""
    text = F.concat(F.lit(f"{seed}/"), F.coalesce("source", F.lit("\u0000")))
    first = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(
        4294967296.0)
    x = first + F.lit(k * _GOLDEN)
    return x - F.floor(x)


def _copies(rank, rate, offset):
    return F.floor(rate * rank + offset) - F.floor(rate * (rank - 1) + offset)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST,
        seed: str = SEED, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Of every row: doc_id, text_key, source, size, source_size, target, copies, taken.

    Null texts have size 0; a null source is a source of its own. Rows that repeat an id
    are ranked by text. A source without a word has target 0 and takes nothing. Runs with
    the same seed agree: offsets come from the source's name, ranks from sizes and ids.
    """
    name = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_of())
    spread = F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long")
    slim = landed(docs.select("doc_id", key_of(text_of()).alias("text_key"), "source",
                              n_words(text_of()).alias("size"), spread.alias("spread")), "sizes")
    by_size = landed(slim.groupBy("source", "size").agg(F.count("*").alias("n")), "by-size")
    sources = by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    shares = landed(targets(sources, weights, share, most), "targets")

    start = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("size").rowsBetween(
        W.unboundedPreceding, -1)), F.lit(0))
    steps = by_size.select("source", "size", start.alias("size_start"),
                           F.ceil(F.col("n") / cell_rows).alias("cells"))
    steps = landed(steps, "steps")

    def same(a, b, *names):
        out = a[names[0]].eqNullSafe(b[names[0]])
        for n in names[1:]:
            out = out & a[n].eqNullSafe(b[n])
        return out

    def add(a, b, *names):
        """Inner join that lets a null source meet a null source."""
        joined = a.join(b, same(a, b, *names))
        for n in names:
            joined = joined.drop(b[n])
        return joined

    cell = F.pmod(F.col("spread"), F.col("cells"))
    placed = landed(add(slim, steps, "source", "size").withColumn("cell", cell), "cells")
    counts = placed.groupBy("source", "size", "cell").agg(F.count("*").alias("n"))
    inner = F.coalesce(F.sum("n").over(W.partitionBy("source", "size").orderBy("cell").rowsBetween(
        W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("source", "size", "cell", inner.alias("cell_start"))
    ranked = add(placed, starts, "source", "size", "cell")
    inside = F.row_number().over(W.partitionBy("source", "size", "cell").orderBy(
        F.col("doc_id").asc_nulls_last(), "text_key"))
    ranked = landed(ranked.withColumn(
        "rank", F.col("size_start") + F.col("cell_start") + inside).select(
        "doc_id", "text_key", "source", "size", "rank"), "ranked")

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = add(ranked, shares, "source").withColumn("rate", rate)
    takes = [F.sum(F.col("size") * _copies(F.col("rank"), F.col("rate"), _draw(seed, k))).alias(
        f"t{k}") for k in range(DRAWS)]
    tried = joined.groupBy("source", "target").agg(*takes)
    misses = F.array(*[F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("miss"),
                                F.lit(k).alias("k"), _draw(seed, k).alias("offset"))
                       for k in range(DRAWS)])
    offsets = landed(tried.select("source", F.array_min(misses)["offset"].alias("offset")), "offsets")
    final = add(joined, offsets, "source").withColumn(
        "copies", _copies(F.col("rank"), F.col("rate"), F.col("offset")).cast("long"))
    return final.select("doc_id", "text_key", "source", "size", "source_size", "target", "copies",
                        (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken, numbered from 1 in ``copy``.

    Of repeated rows (same id, text and source) the one with the smallest hash stands for all
    and takes what they take together, never more than the limit for each.
    """
    found = mix(docs, **options).where("copies > 0").groupBy(
        key_struct("doc_id", "text_key", "source")).agg(F.sum("copies").alias("copies"))
    taken = packed(docs, "source").join(found, "key").groupBy("key").agg(
        F.min_by("row", row_order(docs)).alias("row"), F.max("copies").alias("copies"))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return unpacked(taken, docs.columns, copy.alias(spare(docs.columns, "copy")))
