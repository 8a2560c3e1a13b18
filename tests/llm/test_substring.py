from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidecast.llm import substring as S
from tidecast.llm.fm_index import FMIndex, repeated_windows


def slow(texts: list[str | None], window: int) -> list[tuple[int, int, str]]:
    words = [(t or "").split() for t in texts]
    seen = Counter(tuple(w[j:j + window]) for w in words for j in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j:j + window])] > 1:
                gone[j:j + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def texts_of(seed: int) -> list[str | None]:
    r = random.Random(seed)
    passages = [[r.choice("abcdefgh") for _ in range(r.randint(4, 20))] for _ in range(4)]
    texts = []
    for _ in range(60):
        w = []
        for _ in range(r.randint(0, 5)):
            w += (r.choice(passages) if r.random() < 0.3
                  else [r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, 15))])
        texts.append(" ".join(w))
    return [*texts, texts[3], None, "", "x " * 30, "one\x0btwo\n\nthree"]


@pytest.mark.parametrize("seed,window,run,hot", [
    (0, 5, 2, 10 ** 9), (1, 5, 2, 2), (2, 4, 1, 10 ** 9), (3, 7, 7, 3), (4, 8, 3, 10 ** 9)])
def test_against_all_windows(spark, seed, window, run, hot):
    texts = texts_of(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)],
                               "doc_id long, text string, chunk string").repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in S.repeated_passages(
        df, window=window, anchor_words=run, chunk_words=200, shard_words=300, hot_anchor=hot,
        bucket_rows=16).collect()}
    assert [got[i] for i in range(len(texts))] == slow(texts, window)


def test_long_texts_repeated_rows_null_ids_and_kept_text(spark):
    long = " ".join(f"w{i % 9000}" for i in range(20_000))
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "q a b c"), (2, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_removed"], r["kept_text"][:9]) for r in S.repeated_passages(
        df, window=4, anchor_words=2, with_text=True).collect())
    assert got == [("1", 7, ""), ("1", 7, ""), ("2", 20_000, ""), ("None", 0, "q a b c")]
    assert S.repeated_passages(df.limit(0)).collect() == []


def test_query_against_all_windows(spark):
    from tidecast.llm.queries import all_queries

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"])
           for r in all_queries()["op6_substring_dedup"](spark, sf).collect()}
    want = slow([d["text"] for d in docs], S.WINDOW)
    assert got == {d["doc_id"]: w for d, w in zip(docs, want, strict=True)}


def test_index_counts_patterns():
    r = np.random.default_rng(2)
    text = np.append(r.integers(1, 5, 300), 0)
    index = FMIndex(text, 8)
    for _ in range(50):
        n = int(r.integers(1, 7))
        pattern = r.integers(1, 5, n)
        lo, hi = np.array([0]), np.array([len(text)])
        for c in pattern[::-1]:
            lo, hi = index.step(np.array([c]), lo, hi)
        want = sum((text[i:i + n] == pattern).all() for i in range(len(text) - n + 1))
        assert int(hi[0] - lo[0]) == want


def test_repeated_windows_of_one_pattern():
    text = np.array([1, 2, 3, 4, 9, 1, 2, 3, 7, 0])
    index = FMIndex(text, 12)
    found = repeated_windows(index, text, np.array([0]), np.array([9]), 3)
    spans = {(int(a), int(n)) for _, first, count in found
             for a, n in zip(first, count, strict=True)}
    assert spans == {(0, 1), (5, 1)}
