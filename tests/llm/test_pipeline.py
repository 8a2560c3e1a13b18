from __future__ import annotations

from collections import Counter

import corpus_pipeline as P
from test_decontaminate import shingles
from test_mixing import shared
from test_simhash import similar_classes

from tidecast.llm import decontaminate, exact, mixing, simhash, toxicity
from tidecast.session import landed

SF = "/root/testdata/sf0.01"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(P.STAGES)
    names = docs.columns
    model = toxicity.train(docs, labels)

    before = docs.collect()
    out = landed(stages["toxicity"](spark, docs, SF), "t1")
    rows = out.collect()
    assert out.columns == names
    assert {r["doc_id"] for r in rows} == {
        r["doc_id"] for r in before if model.score((r["text"] or "").encode()) < toxicity.TOXIC_AT}

    best = {}
    for r in rows:
        best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
    out = landed(stages["exact_dedup"](spark, out, SF), "t2")
    assert out.columns == names
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(best.values())

    classes = similar_classes({r["doc_id"]: r["text"] for r in rows})
    out = landed(stages["simhash_near_dedup"](spark, out, SF), "t3")
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(set(classes.values()))

    items = [shingles(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in rows if not any(
        i and len(i & shingles(r["text"])) >= 0.8 * len(i) - 1e-9 for i in items)}
    out = landed(stages["decontamination"](spark, out, SF), "t4")
    rows = out.collect()
    assert {r["doc_id"] for r in rows} == clean and len(rows) == len(clean)

    mix = stages["mixing"](spark, out, SF).collect()
    size = lambda r: len((r["text"] or "").split())
    sizes, largest, taken = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += size(r)
        largest[r["source"]] = max(largest[r["source"]], size(r))
    for r in mix:
        taken[r["source"]] += size(r)
    want = shared(dict(sizes))
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    assert max(Counter(r["doc_id"] for r in mix).values()) <= 2


def test_odd_rows_go_through(spark, folder):
    text = "a plain text of some words that nobody has seen before in this place"
    rows = [(1, text, "en", "s", 3, "x"), (1, text, "en", "s", 3, "x"), (None, text, None, None, None, None),
            (2, None, "en", "s", 0, "y"), (3, "", None, "s", 0, "y"), (4, "w " * 100_000, "en", "t", 9, "z")]
    spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, bits string"
    ).write.parquet(f"{folder}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    got = P.run(spark, folder)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "bits", "copy"]
    assert {r["doc_id"] for r in got.collect()} <= {1, 2, 3, 4}
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, folder)
    assert empty.collect() == []


#: Every name that a stage gives a column of its own, and the pipeline's.
HELPERS = ["__key", "__text", "__row", "__null", "__id", "__score", "__copies", "__source", "key", "row",
           "score", "copies", "copy", "text_key", "hash", "absent", "k0", "c0", "Doc.Id", "item_id", "n"]


def test_no_stage_touches_the_columns_of_users(spark):
    plain = "many plain words about a quiet river and its long winter number "
    rows = [(i, plain + " ".join(f"w{i}x{k}" for k in range(30)), "s", *[f"{h} {i}" for h in HELPERS])
            for i in range(20)]
    rows += [(30, None, None, *HELPERS), (None, "", "s", *HELPERS)]
    names = ["doc_id", "text", "source", *HELPERS]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "nothing of this is in any text")], "item_id long, text string")
    want = sorted(map(str, (tuple(r) for r in rows)))
    for out in (toxicity.clean_documents(docs, labels), simhash.one_of_each(docs, words=5),
                decontaminate.clean_documents(docs, items)):
        assert out.columns == names
        assert set(map(str, map(tuple, out.collect()))) <= set(want)
    assert sorted(str(tuple(r)) for r in decontaminate.clean_documents(docs, items).collect()) == want
    kept = exact.one_of_each(docs)
    assert kept.columns == names and set(str(tuple(r)) for r in kept.collect()) < set(want)
    mix = mixing.mixed(docs)
    assert mix.columns == [*names, "_copy"]
    assert {str(tuple(r)[:-1]) for r in mix.collect()} <= set(want)


def test_of_rows_that_repeat_id_and_text_the_same_one_stays(spark):
    text = "a plain text of some words that nobody has seen before in this place"
    rows = [(1, text, "s", f"note {i}") for i in range(50)]
    names = "doc_id long, text string, source string, note string"
    for stage in (mixing.mixed, simhash.one_of_each, exact.one_of_each):
        one = {r["note"] for r in stage(spark.createDataFrame(rows, names)).collect()}
        two = {r["note"] for r in stage(spark.createDataFrame(rows[::-1], names).repartition(7)).collect()}
        assert len(one) == 1 and one == two
