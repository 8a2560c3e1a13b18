from __future__ import annotations

import hashlib

from tidecast.llm import exact as X


def test_rows_of_every_kind(spark):
    rows = [(1, "a", "x"), (4, "a", "y"), (4, "a", "y"), (2, "A", "z"), (3, None, "n"), (6, "", "e"),
            (None, "a", "q"), (None, "lone", "q"), (7, "b" * 200_000, "l"), (8, "b" * 200_000, "l")]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash string")
    got = X.exact_duplicates(df).collect()
    assert len(got) == len(rows)
    sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in ("a", "A", "", "lone", "b" * 200_000)}
    by = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"])
                for r in got)
    assert by == sorted([
        ("1", "4", 4, False, sha["a"]), ("4", "4", 4, True, sha["a"]),
        ("4", "4", 4, False, sha["a"]), ("2", "2", 1, True, sha["A"]),
        ("3", "6", 2, False, sha[""]), ("6", "6", 2, True, sha[""]),
        ("None", "4", 4, False, sha["a"]), ("None", "None", 1, True, sha["lone"]),
        ("7", "8", 2, False, sha["b" * 200_000]), ("8", "8", 2, True, sha["b" * 200_000])])


def test_the_smallest_may_stay(spark):
    df = spark.createDataFrame([(1, "a"), (4, "a"), (2, "b")], "doc_id long, text string")
    got = {r["doc_id"]: r["keep_id"] for r in X.exact_duplicates(df, keep="smallest").collect()}
    assert got == {1: 1, 4: 1, 2: 2}
    assert sorted(r["doc_id"] for r in X.one_of_each(df, keep="smallest").collect()) == [1, 2]


def test_kept_rows_keep_their_columns(spark):
    df = spark.createDataFrame(
        [(1, "a", "s1", {"k": 1}), (4, "a", "s2", {"k": 2}), (4, "a", "s2", {"k": 2}),
         (None, "", "s3", None), (3, None, None, None), (None, "z", "s4", None)],
        "doc_id long, text string, keep_id string, m map<string,int>")
    kept = X.one_of_each(df)
    assert kept.schema.names == df.schema.names
    got = sorted((str(r["doc_id"]), str(r["text"]), str(r["keep_id"]), str(r["m"]))
                 for r in kept.collect())
    assert got == [("3", "None", "None", "None"), ("4", "a", "s2", "{'k': 2}"),
                   ("None", "z", "s4", "None")]


def test_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert X.exact_duplicates(none).collect() == []
    assert X.one_of_each(none).collect() == []
