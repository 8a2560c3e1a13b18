"""How filters interact: what each removes at its place in every order.

A document that fails some of the five filters survives the subsets of filters that hold none
of these. There are 32 subsets, so a document is a 32-bit word, bit s set where it survives
subset s. What survives each subset is then the positional popcount of these words: a task
adds its words up by carry-save adders, three words of a weight becoming a sum of that weight
and a carry of twice of it, until one word of each weight is left. One row of 32 counts per
task, part and label class is shuffled, and every figure of every order follows from the
counts of a part, since a step only compares the survivors of two subsets.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import landed, n_words, text_of

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Least words; least distinct words and most capitals, in percent; characters that may not occur.
MIN_WORDS, MIN_DISTINCT, MAX_UPPER, SYMBOLS = 100, 80, 10, "[#$%&*|]"
#: Parts that a task counts before it passes their rows on.
PARTS_AT_ONCE = 4096


def survival_word(failed: int) -> int:
    """Bit s is set if none of the failed filters is in subset s."""
    return sum(1 << s for s in range(SUBSETS) if not s & failed)


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the words have each bit set, by carry-save addition."""
    level, counts, weight = words.astype(np.uint32), np.zeros(32, dtype=np.int64), 0
    bits = np.arange(32, dtype=np.uint32)
    while len(level):
        carries = []
        while len(level) > 1:
            k = max(len(level) // 3, 1)
            a, b = level[:k], level[k:2 * k]
            c = level[2 * k:3 * k] if len(level) >= 3 else np.uint32(0)
            half = a ^ b
            carries.append((a & b) | (half & c))
            level = np.concatenate([half ^ c, level[3 * k:]])
        counts += ((level[0] >> bits) & np.uint32(1)).astype(np.int64) << weight
        level, weight = np.concatenate(carries) if carries else level[:0], weight + 1
    return counts


def _distinct_words(text: Column) -> Column:
    bare = F.btrim(text, F.expr("' \\t\\n\\u000B\\u000C\\r'"))
    return F.when(bare == "", 0).otherwise(
        F.size(F.array_distinct(F.split(bare, "[\\x20\\x09-\\x0D]+"))))


def _conditions(text: Column) -> list[Column]:
    """Failure of A to D by the text alone, as 1 or 0."""
    words = n_words(text)
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [(words < MIN_WORDS).cast("int"),
            (100 * _distinct_words(text) < MIN_DISTINCT * words).cast("int"),
            (100 * upper.cast("long") > MAX_UPPER * F.length(text)).cast("int"),
            text.rlike(SYMBOLS).cast("int")]


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part and ``failed``: five bits, A the lowest, of every row.

    E fails where a smaller id has an identical text anywhere in the table. Only the text's
    SHA-256 travels; of a group of copies each task sends one row to find the smallest
    id, and rows meet it by hash and id together, so that no group meets in one task.
    """
    text = text_of()
    a, b, c, d = _conditions(text)
    slim = landed(docs.select(
        "doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("hash"),
        (a + 2 * b + 4 * c + 8 * d).alias("failed")), "filtered")
    first = slim.where("doc_id IS NOT NULL").groupBy("hash").agg(F.min("doc_id").alias("first"))
    first = first.select("hash", F.col("first").alias("doc_id"), F.lit(True).alias("is_first"))
    later = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return slim.join(first, ["hash", "doc_id"], "left").select(
        "doc_id", "part", (F.col("failed") + 16 * later.cast("int")).alias("failed"))


def _classes(labels: DataFrame) -> DataFrame:
    """doc_id and 1 for good plus 2 for toxic, one row of each labelled id."""
    def has(name):
        return F.max(F.coalesce((F.col(name) == 1).cast("int"), F.lit(0)))

    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        (has("quality") + 2 * has("toxic")).alias("class"))


def survivors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, class and ``counts``: of each of the 32 subsets the rows that survive it."""
    words = F.array(*[F.lit(survival_word(m)) for m in range(SUBSETS)])
    rows = failures(docs).join(_classes(labels), "doc_id", "left").select(
        "part", F.coalesce("class", F.lit(0)).alias("class"),
        F.element_at(words, F.col("failed") + 1).cast("long").alias("word"))

    def run(batches):
        sums: dict[tuple[str, int], np.ndarray] = {}

        def flushed():
            keys, counts = list(sums), np.array(list(sums.values()), dtype=np.int64)
            sums.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()),
                 pa.array([k[1] for k in keys], pa.int32()),
                 pa.array(list(counts), pa.list_(pa.int64()))], ["part", "class", "counts"])

        for b in batches:
            coded = b.column("part").dictionary_encode()
            names = coded.dictionary.to_pylist()
            key = coded.indices.to_numpy().astype(np.int64) * 4 + b.column("class").to_numpy()
            order = np.argsort(key, kind="stable")
            words = b.column("word").to_numpy().astype(np.uint32)[order]
            found, starts = np.unique(key[order], return_index=True)
            for k, some in zip(found.tolist(), np.split(words, starts[1:]), strict=True):
                at = (names[k // 4], k % 4)
                sums[at] = sums.get(at, 0) + positional_popcount(some)
            if len(sums) >= PARTS_AT_ONCE:
                yield flushed()
        if sums:
            yield flushed()

    counted = rows.mapInArrow(run, "part string, class int, counts array<long>")
    each = counted.groupBy("part", "class").agg(
        *[F.sum(F.col("counts")[s]).alias(f"n{s}") for s in range(SUBSETS)])
    return each.select("part", "class", F.array(*[f"n{s}" for s in range(SUBSETS)]).alias("counts"))


def _steps() -> list[tuple]:
    """Order, step, filter, and the subsets before and after it, of every step of every order."""
    found = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for i, f in enumerate(order):
            found.append(("".join(FILTERS[x] for x in order), i + 1, f, before, before | 1 << f))
            before |= 1 << f
    return found


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step, zeros included.

    part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley. Null and empty texts fail A, and E where a smaller id is empty as well. A null
    language is the part of the empty one. A row with a null id is never a copy and never a
    smaller id; rows that repeat the smallest id of a text are all first. An id that any label
    row calls good (or toxic) is so. Other columns play no part; an empty table has no parts.
    """
    n = len(FILTERS)
    total = landed(survivors(docs, labels), "survivors")
    sums = [F.array(*[F.sum(F.when(on, F.col("counts")[s]).otherwise(0)) for s in range(SUBSETS)])
            for on in (F.lit(True), F.col("class").isin(1, 3), F.col("class").isin(2, 3))]
    parts = total.groupBy("part").agg(*[x.alias(a) for x, a in zip(
        sums, ("rows", "good", "toxic"), strict=True)])

    def lost(counts: str, f: int, before: int) -> Column:
        return F.col(counts)[before] - F.col(counts)[before | 1 << f]

    def shapley(f: int) -> Column:
        others = [s for s in range(SUBSETS) if not s >> f & 1]
        return sum((lost("rows", f, s) * (factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()))
                    for s in others), F.lit(0).cast("long"))

    full = SUBSETS - 1
    parts = parts.select(
        "*", F.array(*[lost("rows", f, 0) for f in range(n)]).alias("fails"),
        F.array(*[lost("rows", f, full & ~(1 << f)) for f in range(n)]).alias("only"),
        F.array(*[shapley(f) for f in range(n)]).alias("shares"))
    names = ("filter_order", "step", "f", "before", "after")
    steps = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(names, s, strict=True)])
                      for s in _steps()])
    rows = parts.withColumn("at", F.explode(steps)).select("*", "at.*")
    gone = lambda c: F.col(c)[F.col("before")] - F.col(c)[F.col("after")]
    return rows.select(
        "part", "filter_order", "step", F.col("rows")[F.col("after")].alias("kept"),
        gone("rows").alias("removed"), (F.col("fails")[F.col("f")] - gone("rows")).alias("redundant"),
        F.col("only")[F.col("f")].alias("unique_fails"), gone("good").alias("good_lost"),
        gone("toxic").alias("toxic_lost"), F.col("shares")[F.col("f")].alias("shapley"))
