from __future__ import annotations

import random

from tidecast.llm import decontaminate as D


def shingles(text, n=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i:i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def slow(docs, items, t=0.8):
    out = set()
    for d, text in docs:
        have = shingles(text)
        for i, item in items:
            want = shingles(item)
            if want and len(want & have) >= t * len(want) - 1e-9:
                out.add((d, i, len(want), len(want & have)))
    return out


def test_against_all_pairs(spark):
    r = random.Random(8)
    word = lambda: r.choice("abcdefghijklmnopqrstuvwxyz") + r.choice("aeiou")
    items = [(i, " ".join(word() for _ in range(r.randint(1, 40)))) for i in range(30)]
    items += [(30, None), (31, ""), (32, "a b c"), (33, "x x x x x x x x x"), (None, items[3][1])]
    docs = []
    for i in range(150):
        w = [word() for _ in range(r.randint(0, 300))]
        if i % 3 == 0:
            part = r.choice(items[:30])[1].split()
            for _ in range(r.randint(0, 2)):
                part[r.randrange(len(part))] = word()
            at = r.randint(0, len(w))
            w[at:at] = part
        docs.append((i, r.choice([" ", "\n", "  \t"]).join(w)))
    docs += [(200, None), (201, "A  b\nC"), (202, "q " * 20_000 + items[5][1].upper()),
             (203, "x " * 50), (None, items[7][1]), (204, "\x0b" + items[9][1] + "\x0c")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, h int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(g["doc_id"], g["item_id"], g["n_shingles"], g["n_found"])
           for g in D.contaminated(df, bench).collect()}
    want = slow(docs, items)
    assert got == want and len(want) >= 20
    clean = D.clean_documents(df.union(df.limit(1)), bench)
    assert clean.columns == df.columns
    assert {x["doc_id"] for x in clean.collect()} == {d for d, _ in docs} - {d for d, *_ in want}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.contaminated(none, items).collect() == []
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    empty = items.limit(0)
    assert D.contaminated(docs, empty).collect() == []
    assert D.clean_documents(docs, empty).count() == 1


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    plan = D.contaminated(docs, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
