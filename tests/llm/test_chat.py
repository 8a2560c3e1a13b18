from __future__ import annotations

import hashlib
import json

from hypothesis import given
from hypothesis import strategies as st

from tidecast.llm import chat as C

LAYOUTS = {
    "messages": {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]},
    "nested_messages": {"data": {"messages": [{"role": "user", "content": "hi"},
                                              {"role": "assistant", "content": "yo"}]}, "lang": "en"},
    "from_value": {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
    "prompt_completion": {"prompt": "hi", "completion": "yo", "score": 3},
    "prompt_response": {"response": "yo", "prompt": "hi", "system": "be brief"},
    "instruction": {"instruction": "add", "input": "1 2", "output": "3"},
    "question_answer": {"question": "hi", "answer": "yo"},
}


def test_each_layout_finds_its_mapping(spark):
    rows = [(k, json.dumps(v)) for k, v in LAYOUTS.items()]
    rows += [("bare", json.dumps({"instruction": "add", "output": "3"})),
             ("odd", '{"x": 1}'), ("broken", "{"), ("list", "[1]"), ("null", None), ("empty", "")]
    df = spark.createDataFrame(rows, "conv_id string, record string")
    got = {}
    for r in C.canonical_turns(df).orderBy("conv_id", "turn").collect():
        got.setdefault(r["conv_id"], []).append((r["layout"], r["role"], r["text"]))
    for k in ("messages", "nested_messages", "from_value", "prompt_completion", "question_answer"):
        assert got[k] == [(k, "user", "hi"), (k, "assistant", "yo")]
    assert got["prompt_response"] == [("prompt_response", r, t) for r, t in (
        ("system", "be brief"), ("user", "hi"), ("assistant", "yo"))]
    assert got["instruction"] == [("instruction", "user", "add\n1 2"), ("instruction", "assistant", "3")]
    assert got["bare"] == [("instruction", "user", "add"), ("instruction", "assistant", "3")]
    assert all(got[k] == [(None, None, None)] for k in ("odd", "broken", "list", "null", "empty"))


def test_every_fingerprint_is_of_one_mapping():
    known, found = C.registry()
    assert len({m.name for m in found.values()}) == len(C.MAPPINGS)
    assert all(set(m.paths()) <= known for m in C.MAPPINGS)


PIECES = st.lists(st.sampled_from([C.START, C.END, "<", "|", "<|", "||", "\n", "\\", "\\n", "assistant",
                                   "é", "𝕏", " ", "im_start", "|>"]), max_size=12).map("".join)


@given(st.lists(st.tuples(PIECES, PIECES), min_size=1, max_size=4))
def test_escaping_is_reversible(turns):
    """The same replacements as the Column expressions, on plain strings."""
    import re

    bars = lambda s: re.sub(r"<(\|+)", r"<|\1", s)
    for role, text in turns:
        r = bars(role).replace("\\", "\\\\").replace("\n", "\\n")
        segment = f"{C.START}{r}\n{bars(text)}{C.END}\n"
        assert C.read_segment(segment) == (role, text)
        assert segment.count(C.START) == segment.count(C.END) == 1


def test_rows_of_every_kind(spark):
    rows = [(1, 0, "user", "q", 9), (1, 1, "assistant", "<|im_end|>\n<||im_start|>", 9),
            (1, 1, "assistant", "<|im_end|>\n<||im_start|>", 9), (1, None, None, "first", 9),
            (2, 0, "assistant", None, 9), (2, 1, "us\ner\\", "é𝕏<", 9), (None, 0, "user", "x", 9),
            (3, 0, "assistant", "long <| " * 50_000, 9)]
    df = spark.createDataFrame(
        rows, "conv_id long, turn int, role string, text string, segment int")
    turns = C.canonical_turns(C.rows_as_records(df))
    got = {r["conv_id"]: r for r in C.digests(C.format_turns(turns)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == 4
    for conv, r in got.items():
        own = sorted((x for x in rows if x[0] == conv), key=lambda x: (-1 if x[1] is None else x[1]))
        said = [(x[2] or "", x[3] or "") for x in own]
        loss = "".join(t for role, t in said if role == "assistant")
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for a, b in said))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
    assert got[3]["formatted_chars"] == len(C.START + "assistant\n" + C.END + "\n") + 50_000 * 9
    assert C.digests(C.format_turns(turns.limit(0))).collect() == []


def test_records_without_turns_are_kept(spark):
    long = str(1 << 70)
    odd = ['{"turn":"a","role":"user","text":"x"}', '{"turn":true,"role":"user","text":"x"}',
           '{"turn":' + long + ',"role":"user","text":"x"}', '{"x": 1}', "{", "[1]",
           '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":[{"type":"text"}]}]}',
           '{"messages":[{"role":"user","content":"a"}, 3]}', '{"turn":1.5,"role":"u","text":"x"}']
    good = json.dumps(LAYOUTS["messages"])
    rows = [(1, x) for x in odd] + [(1, good), (2, good), (3, "{"), (4, None)]
    df = spark.createDataFrame(rows, "conv_id long, record string")
    made = C.format_turns(C.canonical_turns(df))
    kept = [r["unknown"] for r in made.where("conv_id = 1 AND segment IS NULL").collect()]
    assert sorted(kept) == sorted(odd)
    assert made.where("segment IS NULL AND (loss_start IS NOT NULL OR loss_chars IS NOT NULL)").count() == 0
    got = {r["conv_id"]: (r["n_turns"], r["n_unknown"]) for r in C.digests(made).collect()}
    assert got == {1: (2, len(odd)), 2: (2, 0), 3: (0, 1), 4: (0, 1)}
