from __future__ import annotations

import itertools
import zlib

import numpy as np

from tidecast.llm import quality_crf as Q


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_marginals_are_those_of_all_labellings():
    r = np.random.default_rng(1)
    lengths = np.array([3, 0, 1, 5, 2])
    z, stay = r.normal(size=lengths.sum()), 0.8
    good, same = Q.marginals(z, lengths, stay)
    at = 0
    for n in lengths:
        part, total, ones, pairs = z[at:at + n], 0.0, np.zeros(n), np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            y = np.array(y)
            alike = np.append(False, y[1:] == y[:-1])[:n]
            weight = np.exp(part @ y + stay * alike.sum())
            total, ones, pairs = total + weight, ones + weight * y, pairs + weight * alike
        assert np.allclose(good[at:at + n], ones / total)
        assert np.allclose(same[at + 1:at + n], (pairs / total)[1:])
        at += n


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in Q.judge(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == held_out(i) and r["predicted"] == int(r["score"] >= 0.3)
               and 0 <= r["score"] <= 1 for i, r in got.items())
    right = [got[x["doc_id"]]["predicted"] == x["quality"] for x in labels.collect()
             if got[x["doc_id"]]["held_out"]]
    assert np.mean(right) > 0.95


def test_labels_of_the_held_out_fold_are_not_learnt_from(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", Q.F.when(Q.fold(Q.FOLDS) == Q.HELD_OUT, 1 - labels["quality"])
                               .otherwise(labels["quality"]))
    a, b = Q.train(docs, labels), Q.train(docs, turned)
    assert np.array_equal(a.weights, b.weights) and (a.slope, a.offset) == (b.slope, b.offset)


def test_rows_of_every_kind(spark):
    good = "The house stood by the river, and the road went on to the town.\n" * 4
    bad = "## $$ ## %% &&\n| a | b |\n" * 4
    ids = [i for i in range(60) if not held_out(i)]
    rows = [(i, good if i % 2 else bad, 0.5) for i in ids]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in ids] + [(ids[0], None, 0), (None, 1, 0),
                                                                   (ids[1], 1, 0), (ids[2], 1, 0)],
                                   "doc_id long, quality int, toxic int")
    rows += [(1000, None, 1.0), (1001, "", 1.0), (1002, " \n \n", 1.0), (None, good, 1.0),
             (1003, good * 3000, 1.0), (1003, good * 3000, 1.0), (1004, "word " * 100_000, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = Q.judge(df, labels).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["score"] for i in (1000, 1001, 1002)] == [Q.EMPTY_SCORE] * 3
    assert by[None]["held_out"] is False and by[None]["predicted"] == 1
    assert by[1003]["predicted"] == 1
    assert all(by[i]["predicted"] == i % 2 for i in ids)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(r["score"] for r in Q.judge(docs, none).collect()) == [0.0, 0.5]
    assert Q.judge(docs.limit(0), none).collect() == []


def test_bad_lines_at_the_end_of_long_texts_are_learnt(spark):
    """Labelled bad documents start with a thousand good lines; nothing of them is cut."""
    import random

    r = random.Random(6)
    words = "the river runs past an old house where people walk in the early morning".split()
    good = lambda: " ".join(r.choices(words, k=12)).capitalize() + "."
    bad = lambda: "".join(r.choices("#$%&*@^~=+<>{}[]0123456789", k=40))
    ids = [i for i in range(60) if not held_out(i)]
    rows = [(i, "\n".join([good() for _ in range(1000)] + [bad() if i % 2 else good() for _ in range(1000)]))
            for i in ids]
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in ids], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["score"] for x in Q.judge(docs, labels).collect()}
    # By their first thousand lines they are all alike.
    wrong = {i: got[i] for i in ids if (got[i] > 0.5) != (i % 2 == 0)}
    assert not wrong
