from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np

from tidecast.llm import toxicity as T


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in T.judge(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == held_out(i) and r["predicted"] == int(r["score"] >= 0.7)
               and 0 <= r["score"] <= 1 for i, r in got.items())
    seen = Counter((x["toxic"], got[x["doc_id"]]["predicted"]) for x in labels.collect()
                   if got[x["doc_id"]]["held_out"])
    assert seen[1, 1] > 0.85 * (seen[1, 1] + seen[1, 0])  # toxic ones found
    assert seen[0, 1] < 0.02 * (seen[0, 0] + seen[0, 1])  # clean ones left alone


def fitted(fairness: float) -> T.Model:
    """Texts in which one group is named in bad company more often than its counterpart."""
    r = random.Random(2)
    rows, y, swaps = [], [], []
    for i in range(400):
        toxic = i % 2
        words = r.sample(["river", "house", "market", "garden", "winter", "letter"], 3)
        if toxic and r.random() < 0.7:
            words.append("idiot")
        group = "muslims" if r.random() < (0.8 if toxic else 0.1) else "christians"
        words.append(group)
        text = " ".join(words).encode()
        swaps += T.swaps_of(text)
        f = T.text_features(text)
        rows.append((list(f), list(f.values())))
        y.append(toxic)
    return T.fit_rows(rows, y, np.full(400, 1 / 400), swaps, fairness=fairness)


def test_swapping_a_group_hardly_changes_the_score():
    a, b = "the muslims had a garden.".encode(), "the christians had a garden.".encode()
    plain, fair = fitted(0.0), fitted(10.0)
    assert plain.score(a) - plain.score(b) > 0.4
    assert abs(fair.score(a) - fair.score(b)) < 0.1
    assert fair.score(b"muslims garden") < T.TOXIC_AT < fair.score(b"muslims garden idiot")


def test_rows_of_every_kind(spark):
    ids = [i for i in range(200) if not held_out(i)]
    text = lambda i: f"calm words about number{i} " + ("vile idiot" if i % 4 == 0 else "fine day")
    rows = [(i, text(i), 1.5) for i in ids]
    labels = spark.createDataFrame(
        [(i, 1, int(i % 4 == 0)) for i in ids] + [(ids[0], 1, None), (None, 1, 1), (ids[1], 1, 1)],
        "doc_id long, quality int, toxic int")
    rows += [(1000, None, 1.0), (1001, "", 1.0), (None, "a vile idiot", 1.0), (1002, "Vile IDIOT!", 1.0),
             (1003, "fine day " * 60_000, 1.0), (1003, "fine day " * 60_000, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = T.judge(df, labels).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1000]["score"] == by[1001]["score"]
    assert by[None]["predicted"] == by[1002]["predicted"] == 1 and by[1003]["predicted"] == 0
    assert by[None]["held_out"] is False
    clean = T.clean_documents(df, labels)
    assert clean.columns == df.columns
    assert clean.count() == len(rows) - sum(r["predicted"] for r in got)


def test_labels_of_the_held_out_fold_are_not_learnt_from(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept = labels.where(T.fold(T.FOLDS) != T.HELD_OUT)
    assert T.train(docs, labels) == T.train(docs, kept)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in T.judge(docs, none).collect()] == [0.5, 0.5]
    assert T.judge(docs.limit(0), none).collect() == []
    assert T.clean_documents(docs, none).count() == 2


def test_score_is_the_fitted_sum_on_short_and_long_texts(spark):
    model = fitted(10.0)
    assert model.weights
    long = " ".join(f"muslims{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)) + " idiot river"
    texts = ["idiot", "muslims garden idiot", "", long, long + " idiotic idiots"]
    want = []
    for t in texts:
        counts = T.text_features(t.encode())
        z = model.bias + sum(model.weights.get(f, 0.0) * np.log1p(n) for f, n in counts.items())
        want.append(1 / (1 + np.exp(-z)))
    assert np.allclose([model.score(t.encode()) for t in texts], want, rtol=1e-9)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["c0"]: r["score"] for r in T.scores(df, model, ["doc_id"]).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], want, rtol=1e-9)


def test_a_swapped_sentence_is_made_and_compared():
    text = "The zorgs came. A river and the zorgs, zorgian zorgs! Nothing here".encode()
    terms = (("zorgs", "blips", "quuxes"),)
    got = T.swaps_of(text, terms)
    assert len(got) == 4  # two sentences, two other names
    for (found, values), (old, new) in zip(got, [
            ("the zorgs came", "the blips came"), ("the zorgs came", "the quuxes came"),
            ("a river and the zorgs zorgian", "a river and the blips zorgian"),
            ("a river and the zorgs zorgian", "a river and the quuxes zorgian")], strict=True):
        a, b = T.text_features(old.encode()), T.text_features(new.encode())
        want = {f: np.log1p(b[f]) - np.log1p(a[f]) for f in a | b if a[f] != b[f]}
        assert dict(zip(found, values, strict=True)) == want
    assert T.swaps_of(text, (("other", "another"),)) == []


def test_terms_given_to_the_fit_are_swapped(spark):
    """Sentences planted in labelled documents go all the way through ``train``."""
    r, rows, labels = random.Random(4), [], []
    for i in (i for i in range(900) if not held_out(i)):
        toxic = i % 2
        words = r.sample(["river", "house", "market", "garden", "winter", "letter"], 3)
        words.append("zorgs" if r.random() < (0.8 if toxic else 0.1) else "blips")
        if toxic and r.random() < 0.7:
            words.append("idiot")
        rows.append((i, "Some plain words. " + " ".join(words) + "."))
        labels.append((i, 1, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    gap = lambda m: m.score(b"the zorgs had a garden") - m.score(b"the blips had a garden")
    assert gap(T.train(docs, marks)) > 0.3  # the usual terms say nothing of these
    fair = T.train(docs, marks, terms=(("zorgs", "blips"),))
    assert abs(gap(fair)) < 0.1 and fair.score(b"a blips idiot") > 0.6


def test_many_rows_of_one_labelled_id(spark):
    from tidecast.llm.labelled import sample

    ids = [i for i in range(40) if not held_out(i)]
    docs = spark.range(50_000).selectExpr(f"{ids[0]} AS doc_id", "concat('text ', id) AS text").unionByName(
        spark.createDataFrame([(i, f"word{i}") for i in ids[1:]], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in ids], "doc_id long, quality int, toxic int")
    got, sizes = sample(docs, labels, "toxic", 3, 1, 2000)
    assert got.count() == len(ids) == sum(sizes.values())
