from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidecast.llm import fill_middle as M


def slow(doc_id, text):
    """The same rule over characters: n, form, prefix, middle, output."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    text = text or ""
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def rows():
    rng = random.Random(5)
    parts = ["a", "é", "漢", "🌊", " ", "\n", "ź", "<", "P>", "<S", "\u0000", "w" * 9]
    found = [(i, "".join(rng.choices(parts, k=rng.randint(0, 40)))) for i in range(400)]
    return [*found, (3, "again"), (3, "again"), (None, "no id"), (None, None), (900, None), (901, ""),
            (902, "has <P> in it"), (903, "🌊" * 300_000), (904, "x" * 1_000_001), (905, "<P"), (906, "€")]


def test_against_slicing(spark):
    given_rows = [(i, t, "x", i) for i, t in rows()]
    df = spark.createDataFrame(given_rows, "doc_id long, text string, form string, n long").repartition(3)
    made = M.transform(df)
    got = made.select("*", M.restored().alias("back")).collect()
    want = sorted((str(i), *map(str, slow(i, t)), str(t or "")) for i, t in rows())
    assert sorted(tuple(map(str, r)) for r in got) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_options_and_empty(spark):
    df = spark.createDataFrame([(i, f"text {i} of some length") for i in range(50)], "doc_id long, text string")
    all_spm = M.transform(df, plain_percent=0, spm_percent=100).collect()
    assert {r["form"] for r in all_spm} == {"spm"}
    assert {r["form"] for r in M.transform(df, plain_percent=100).collect()} == {"plain"}
    assert M.transform(df.limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=8))
def test_units_of_a_buffer(texts):
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    units, text = M.Units(data), "".join(texts)
    ends = np.cumsum([len(c.encode()) for c in text]).astype(np.int64)
    assert units.end_of(np.arange(1, len(text) + 1)).tolist() == ends.tolist()
    at = np.arange(len(data) + 1)
    assert units.before(at).tolist() == np.searchsorted(ends, at, side="right").tolist()
    column = pa.array(["skip", *texts]).slice(1)
    zero = np.zeros(len(texts), dtype=np.int64)
    assert M._cut_points(column, zero, zero)[4].tolist() == [len(t) for t in texts]
