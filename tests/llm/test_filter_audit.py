from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidecast.llm import filter_audit as A


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=200))
def test_popcount_of_each_bit(words):
    got = A.positional_popcount(np.array(words, dtype=np.uint32))
    assert got.tolist() == [sum(w >> b & 1 for w in words) for b in range(32)]


def slow(docs, labels):
    """Every order walked through, document by document."""
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    seen = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {f for f, x in zip("ABCDE", (
            len(words) < 100, 100 * len(set(words)) < 80 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 10 * len(text), re.search("[#$%&*|]", text),
            i is not None and i > first[text]), strict=True) if x}
        seen.append((lang or "", fails, i is not None and i in good, i is not None and i in toxic))
    out, shares = [], Counter()
    for order in permutations("ABCDE"):
        for part in {s[0] for s in seen}:
            left = [s for s in seen if s[0] == part]
            every = left
            for step, f in enumerate(order, 1):
                gone = [s for s in left if f in s[1]]
                left = [s for s in left if f not in s[1]]
                shares[part, f] += len(gone)
                out.append((part, "".join(order), step, f, len(left), len(gone),
                            sum(f in s[1] for s in every) - len(gone), sum(s[1] == {f} for s in every),
                            sum(s[2] for s in gone), sum(s[3] for s in gone)))
    return sorted((*r[:3], *r[4:], shares[r[0], r[3]]) for r in out)


def test_against_every_order(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(160):
        text = " ".join(rng.choices(words[:rng.choice([20, 400])], k=rng.choice([5, 60, 99, 100, 101, 160])))
        text = text.upper() if rng.random() < 0.3 else text
        docs.append((i, text + rng.choice(["", "", " #"]), rng.choice(["en", "de", None, ""])))
    docs += [(200 + i, docs[rng.randrange(60)][1], "en") for i in range(40)]
    docs += [docs[3], docs[3], (None, docs[4][1], "en"), (None, None, None), (300, None, "fr"),
             (301, "", "fr"), (302, "a b " * 50_000, "fr"), (0, docs[150][1], "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 240, 2)]
    labels += [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    df = spark.createDataFrame([(*d, "x", 7) for d in docs],
                               "doc_id long, text string, lang string, part string, failed int")
    lf = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = A.audit(df.repartition(5), lf)
    assert sorted(tuple(r) for r in got.collect()) == slow(docs, labels)
    assert A.audit(df.limit(0), lf).collect() == []
    assert A.audit(df, lf.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_many_parts_are_passed_on(spark, monkeypatch):
    monkeypatch.setattr(A, "PARTS_AT_ONCE", 3)
    df = spark.createDataFrame([(i, "x", f"l{i % 40}") for i in range(400)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = A.survivors(df, none).collect()
    assert len(got) == 40 and {r["counts"][0] for r in got} == {10}
