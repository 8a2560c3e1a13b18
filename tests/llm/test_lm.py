from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from tidecast.llm import ngram_lm as L
from tidecast.llm import tokens as T


def slow(docs: list[str | None], order: int, backoff: float = 0.4) -> list[float]:
    words = [(t or "").split() for t in docs]
    own = [Counter(tuple(w[j:j + n]) for n in range(1, order + 1) for j in range(len(w) - n + 1))
           for w in words]
    total, size = sum(own, Counter()), sum(map(len, words))
    out = []
    for w, mine in zip(words, own, strict=True):
        score = 0.0
        for j in range(len(w)):
            n = min(j, order - 1) + 1
            while n > 1 and total[tuple(w[j - n + 1:j + 1])] == mine[tuple(w[j - n + 1:j + 1])]:
                score, n = score + math.log(backoff), n - 1
            gram = tuple(w[j - n + 1:j + 1])
            count = total[gram] - mine[gram]
            below = total[gram[:-1]] - mine[gram[:-1]] if n > 1 else max(size - len(w), 1)
            score += math.log((count or L.UNSEEN) / below)
        out.append(score)
    return out


TEXTS = ["a b c a b c d", "a b c x y", "", "b c d a b", None, "q r s a b c d e f", "z",
         "a b a b a b a b", "z", "long " * 3000, "été été"]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_are_those_of_counting(spark, order):
    rows = [(i, t, 0.5) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words double").repartition(3)
    got = {r["doc_id"]: r for r in
           L.scores(df, order=order, chunk_words=8, bucket_rows=4).collect()}
    for (i, t, _), want in zip(rows, slow(TEXTS, order), strict=True):
        n = len((t or "").split())
        assert got[i]["n_words"] == n and abs(got[i]["log_score"] - want) < 1e-6
        if n:
            assert abs(got[i]["perplexity"] - math.exp(-want / n)) < 1e-6 * math.exp(-want / n)
        else:
            assert got[i]["mean_score"] is None and got[i]["perplexity"] is None


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), round(r["log_score"], 9)) for r in L.scores(df).collect())
    want = slow(["a b", "a b", "c"], L.ORDER)
    assert got == sorted(zip(["1", "1", "None"], (round(w, 9) for w in want), strict=True))
    assert L.scores(df.limit(0)).collect() == []


def test_query_against_counting(spark):
    from tidecast.llm.queries import all_queries

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r["doc_id"]: r["log_score"] for r in all_queries()["op4_lm_score"](spark, sf).collect()}
    want = slow([d["text"] for d in docs], L.ORDER)
    assert all(abs(got[d["doc_id"]] - w) < 1e-6 * max(1, -w)
               for d, w in zip(docs, want, strict=True))


def test_packed_numbers():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2 ** 40, 2 ** 62, 5])
    assert T.unpack(T.pack(values)).tolist() == values.tolist()
    assert len(T.unpack(T.pack(values[:0]))) == 0
