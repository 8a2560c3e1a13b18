"""Stupid-backoff language-model scores of every document.

The counts are those of the whole corpus. Chunks of documents list their distinct n-grams;
the lists are partitioned by hash, counted there, and the counts are joined back to the
chunk, where each document's scores are summed. A document's own n-grams are taken out of
the counts it is scored with, or else every n-gram it has would be a known one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import landed
from tidecast.llm.tokens import (BUCKET_ROWS, CHUNK_WORDS, Chunk, answered, answers, bucket_bits,
                                 chunked, questions, rows_of, totals_of)

ORDER = 2
BACKOFF = 0.4
#: What counts as the frequency of a word that no other document has.
UNSEEN = 0.5


def _ask(order: int):
    def ask(c: Chunk) -> dict[int, np.ndarray]:
        h = c.hashes()
        return {n: c.ngrams(h, n)[c.inside(n)] for n in range(1, order + 1)}

    return ask


def _own(index: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """How often each occurrence's n-gram occurs in its own document."""
    _, at, n = np.unique(index.astype(np.int64) * docs + doc, return_inverse=True,
                         return_counts=True)
    return n[at]


def word_scores(c: Chunk, totals: dict[int, np.ndarray], corpus_words: int, order: int = ORDER,
                backoff: float = BACKOFF) -> np.ndarray:
    """Log score of each word: the longest n-gram known elsewhere over its context.

    Each word that the context is shortened by costs a factor; at the start of a document
    the context is as short as it is, at no cost.
    """
    n_words, docs = len(c.ids), len(c.lengths)
    doc = np.repeat(np.arange(docs), c.lengths)
    place = np.arange(n_words) - c.starts[doc]
    h = c.hashes()
    others = {}  # by order: counts in other documents of the n-gram that starts at a position
    for n in range(1, order + 1):
        at = c.inside(n)
        _, index = np.unique(c.ngrams(h, n)[at], return_inverse=True)
        count = np.zeros(n_words, np.int64)
        count[at] = totals[n][index] - _own(index, doc[at], max(docs, 1)) if len(at) else 0
        others[n] = count
    rest = np.maximum(corpus_words - c.lengths[doc], 1)
    score = np.log(np.where(others[1] > 0, others[1], UNSEEN) / rest)
    score += np.log(backoff) * np.minimum(place, order - 1)
    for n in range(2, order + 1):
        i = np.flatnonzero(place >= n - 1)
        i = i[others[n][i - n + 1] > 0]
        seen = np.log(others[n][i - n + 1] / others[n - 1][i - n + 1])
        score[i] = seen + np.log(backoff) * np.maximum(np.minimum(place[i], order - 1) - (n - 1), 0)
    return score


def scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF,
           chunk_words: int = CHUNK_WORDS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Of every row: doc_id, n_words, log_score (the sum), mean_score, perplexity.

    Null texts and texts without a word have n_words 0, log_score 0 and a null mean and
    perplexity. Rows are documents of their own: a repeated row counts as another document.
    Null ids and further columns make no difference.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    chunks = chunked(docs, chunk_words)
    words = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    total = int(chunks.agg(F.coalesce(F.sum(words), F.lit(0))).first()[0])
    bits = bucket_bits(total * order, bucket_rows)
    found = landed(answers(questions(chunks, _ask(order), bits)), "counts")

    def run(batches):
        for b in batches:
            ids = b.column("ids")
            for i, row in enumerate(rows_of(b.drop_columns(["ids"]), 1)):
                c = Chunk(row["lengths"], row["vocab"], row["tokens"])
                by_order = {n: totals_of(row["answers"], n) for n in range(1, order + 1)}
                doc = np.repeat(np.arange(len(c.lengths)), c.lengths)
                summed = np.bincount(doc, word_scores(c, by_order, total, order, backoff),
                                     len(c.lengths))
                yield pa.RecordBatch.from_arrays(
                    [ids[i].values, pa.array(c.lengths), pa.array(summed)],
                    ["doc_id", "n_words", "log_score"])

    scored = answered(chunks, found).select("ids", "lengths", "vocab", "tokens", "answers")
    out = scored.mapInArrow(run, f"doc_id {kind}, n_words long, log_score double")
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return out.select("doc_id", "n_words", "log_score", mean.alias("mean_score"),
                      F.exp(-mean).alias("perplexity"))
