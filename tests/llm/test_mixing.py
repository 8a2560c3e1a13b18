from __future__ import annotations

import random
from collections import defaultdict

from tidecast.llm import mixing as M


def shared(sizes: dict, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0) -> dict:
    """Targets by sharing the excess again until none is above its limit."""
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, left = dict.fromkeys(order, 0.0), set(order), share * sum(sizes.values())
    while True:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > most * sizes[s] + 1e-9]
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
            free.discard(s)
            left -= out[s]


def test_targets_are_those_of_sharing_again(spark):
    r = random.Random(3)
    for _ in range(6):
        sizes = {f"s{i}" if i else None: r.choice([0, r.randint(1, 50), r.randint(1, 5000)])
                 for i in range(r.randint(1, 9))} | {"é": 70}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {x["source"]: x["target"] for x in M.targets(df).collect()}
        want = shared(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes), (got, want)


def docs_of(spark):
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 40, 200])), f"s{i % 4}", 1) for i in range(400)]
    rows += [(1000 + i, "word " * r.randint(1, 30), None, 2) for i in range(60)]
    rows += [(5, "again and again", "s1", 3)] * 3
    rows += [(None, "no id here", "s2", 4), (7000, None, "s3", 5), (7001, "", "only empty", 6),
             (8000, "long " * 5000, "s0", 7)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, rank int")


def test_each_source_comes_near_its_target(spark):
    rows, df = docs_of(spark)
    for cell_rows in (10_000, 7):
        got = M.mix(df, cell_rows=cell_rows).collect()
        assert len(got) == len(rows)
        assert sorted(g["size"] for g in got) == sorted(len((t or "").split()) for _, t, _, _ in rows)
        taken, target, largest = defaultdict(int), {}, defaultdict(int)
        for g in got:
            assert 0 <= g["taken"] <= 2 * g["size"]
            taken[g["source"]] += g["taken"]
            target[g["source"]] = g["target"]
            largest[g["source"]] = max(largest[g["source"]], g["size"])
        sizes = defaultdict(int)
        for _, t, s, _ in rows:
            sizes[s] += len((t or "").split())
        want = shared(sizes)
        for s in sizes:
            assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
            assert abs(taken[s] - target[s]) <= largest[s]


def test_runs_agree_whatever_the_partitions(spark):
    _, df = docs_of(spark)
    a = sorted(map(str, M.mix(df.repartition(2)).collect()))
    assert a == sorted(map(str, M.mix(df.repartition(7, "text")).collect()))


def test_the_mix_repeats_rows(spark):
    rows, df = docs_of(spark)
    out = M.mixed(df.withColumnRenamed("rank", "copy"))
    assert out.columns == ["doc_id", "text", "source", "copy", "_copy"]
    words = sum(len((r["text"] or "").split()) for r in out.collect())
    assert words == sum(g["taken"] for g in M.mix(df).collect())


def test_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix(none).collect() == []
    assert M.mixed(none).collect() == []
