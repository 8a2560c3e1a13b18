from __future__ import annotations

import math

import numpy as np
import pytest

from tidecast.llm import embeddings as E


def slow(rows, cosine=0.98):
    """vec_id, n_links, component_id of every row, by comparing all."""
    def usable(r):
        v = r[1]
        return (r[2] is not None and v and all(x is not None and math.isfinite(x) for x in v)
                and any(v))

    n = len(rows)
    unit = [np.array(r[1], dtype=float) / np.abs(r[1]).max() if usable(r) else None for r in rows]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    near = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None
             and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j])
             and unit[i] @ unit[j] >= cosine] for i in range(n)]
    out, top = [], list(range(n))
    for start in range(n):
        seen, todo = {start}, [start]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        top[start] = min(ids) if ids else None
    for i, r in enumerate(rows):
        out.append((str(r[0]), len(near[i]), str(top[i]), r[0] == top[i]))
    return sorted(out)


def planted(seed=1, n=900, d=12):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, d))
    rows = []
    for i in range(n):
        v = base[rng.integers(40)] + rng.normal(size=d) * rng.choice([0.05, 0.12, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v * rng.choice([1.0, 7.0])], int(rng.integers(3))))
    rows += [(1000 + i, rows[i % 5][1], rows[i % 5][2]) for i in range(60)]
    rows += [(rows[0][0], rows[0][1], rows[0][2]), (None, rows[1][1], rows[1][2]), (None, [5.0] * d, 1),
             (2000, None, 1), (2001, [0.0] * d, 1), (2002, [math.nan] + [1.0] * (d - 1), 1),
             (2003, [math.inf] * d, 1), (2004, [None] + [1.0] * (d - 1), 1), (2005, rows[2][1], None),
             (2006, [], 1), (2007, [1.0, 2.0], 1), (2008, [2.0, 4.0], 1), (2009, [2.0, 4.0], 2),
             (2010, [-0.0, 3.0], 1), (2011, [0.0, 1.0], 1), (2012, [1e30] * d, 1), (2013, [1e-30] * d, 1)]
    return rows


@pytest.mark.parametrize("options", [{}, {"cell_rows": 40}, {"cell_rows": 7, "most_cells": 60, "sample_rows": 100}])
def test_against_all_pairs(spark, monkeypatch, options):
    monkeypatch.setattr(E, "LEAST_BLOCK", 16)
    rows = planted()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows],
                               "vec_id long, embedding array<float>, label int, node string, copies int")
    got = E.near_duplicates(df.repartition(4), **options).collect()
    want = slow(rows)
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got) == want
    assert sum(n for _, n, _, _ in want) > 2000  # and there is something to find


def test_cells_lose_no_link():
    """Every linked pair meets in one cell, whatever the centres are."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 6))
    x = np.concatenate([x + rng.normal(size=x.shape) * 0.1 for _ in range(8)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = rng.normal(size=(25, 6))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    at = E.cells_of(x, centres, 0.98)
    meets = (at > 0).astype(int) @ (at > 0).T - (at == 1).astype(int) @ (at == 1).T
    linked = x @ x.T >= 0.98
    assert (meets[linked] >= 1).all()
    once = (at == 2).astype(int) @ (at > 0).T
    assert ((once + once.T - (at == 2).astype(int) @ (at == 2).T)[linked] == 1).all()


def test_doubles_empty_and_bad_cosine(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], "x"), ("b", [1.0, 1e-9], "x"), ("c", [0.0, 1.0], "x")],
                               "vec_id string, embedding array<double>, label string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in E.near_duplicates(df).collect()}
    assert got == {"a": (1, "a", True), "b": (1, "a", False), "c": (0, "c", True)}
    assert E.near_duplicates(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        E.near_duplicates(df, cosine=0.0)
