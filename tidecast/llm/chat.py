"""Chat formatting: records of many layouts into one template, reversibly.

A record is a JSON object. The hash of its nested field paths, as far as any mapping knows
them, selects the mapping that turns it into canonical turns (conversation, turn, role,
text). Turns become segments of a template that marks roles with control strings; control
strings inside texts are escaped, and each segment says where its loss mask lies.

A conversation is never gathered: turns are rows, in order inside a partition, and what
needs a whole conversation (digests) reads its rows as a stream.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_SEGMENT = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.DOTALL)


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns.

    ``turns`` lists (role, path of the text) for layouts with a field per turn; ``each``
    names the list whose elements are turns, with the fields of role and text in them.
    ``row`` marks a layout whose record is one turn. ``optional`` paths may be absent.
    """

    name: str
    turns: tuple[tuple[str, str], ...] = ()
    each: tuple[str, str, str] | None = None
    row: tuple[str, str, str] | None = None
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    def paths(self) -> list[str]:
        if self.each:
            top, role, text = self.each
            return [f"{top}[].{role}", f"{top}[].{text}"]
        return [p for p in self.row] if self.row else [p for _, p in self.turns]


SHAREGPT = {"human": "user", "gpt": "assistant", "bot": "assistant", "chatgpt": "assistant"}
MAPPINGS = (
    Mapping("row", row=("turn", "role", "text")),
    Mapping("messages", each=("messages", "role", "content")),
    Mapping("nested_messages", each=("data.messages", "role", "content")),
    Mapping("from_value", each=("conversations", "from", "value"), roles=SHAREGPT),
    Mapping("prompt_completion", turns=(("system", "system"), ("user", "prompt"),
                                        ("assistant", "completion")), optional=("system",)),
    Mapping("prompt_response", turns=(("system", "system"), ("user", "prompt"),
                                      ("assistant", "response")), optional=("system",)),
    Mapping("instruction", turns=(("system", "system"), ("user", "instruction"),
                                  ("user", "input"), ("assistant", "output")),
            optional=("system", "input")),
    Mapping("question_answer", turns=(("user", "question"), ("assistant", "answer"))),
)


def field_paths(value, at: str = "") -> set[str]:
    """Paths of the leaves of a JSON value; list elements share the path ``[]``."""
    if isinstance(value, dict):
        return set().union(*[field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()])
    if isinstance(value, list):
        return set().union(*[field_paths(v, f"{at}[]") for v in value])
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def registry(mappings=MAPPINGS) -> tuple[set[str], dict[str, Mapping]]:
    """The paths that count, and the mapping of each fingerprint."""
    known = {p for m in mappings for p in m.paths()}
    found: dict[str, Mapping] = {}
    for m in mappings:
        must = set(m.paths()) - set(m.optional)
        for k in range(len(m.optional) + 1):
            for more in itertools.combinations(m.optional, k):
                found.setdefault(fingerprint(must | set(more)), m)
    return known, found


def _get(value, path: str):
    for name in path.split("."):
        value = value.get(name) if isinstance(value, dict) else None
    return value


def _text(value) -> str:
    """A plain value as text; what has parts of its own is no text of a turn."""
    if isinstance(value, (dict, list)):
        raise ValueError("a text made of parts")
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def record_turns(record: dict, m: Mapping) -> list[tuple[int | None, str, str]]:
    """Turns of a record; ValueError if its values are not what the layout needs."""
    if m.row:
        turn, role, text = m.row
        number = record[turn]
        if number is not None and (type(number) is not int or not -(1 << 63) <= number < 1 << 63):
            raise ValueError("a turn without a number")
        return [(number, _text(record[role]), _text(record[text]))]
    if m.each:
        top, role, text = m.each
        each = _get(record, top)
        if not all(isinstance(x, dict) for x in each):
            raise ValueError("a turn that is no object")
        said = [(_text(_get(x, role)), _text(_get(x, text))) for x in each]
    else:
        said = [(role, _text(_get(record, path))) for role, path in m.turns
                if _get(record, path) is not None]
        said = [(role, "\n".join(t for _, t in same))  # instruction and input are one turn
                for role, same in itertools.groupby(said, key=lambda x: x[0])]
    return [(i, m.roles.get(role, role), text) for i, (role, text) in enumerate(said)]


def canonical_turns(records: DataFrame, mappings=MAPPINGS) -> DataFrame:
    """conv_id, turn, role, text, layout, unknown from (conv_id, record).

    A record that is no JSON object, of an unknown layout, or with a turn that is no number or
    a text that has parts, gives one row whose layout is null and that carries the record in
    ``unknown``, so that none is lost. Null texts are empty.
    """
    kind = records.schema["conv_id"].dataType.simpleString()
    known, by_print = registry(mappings)
    prints: dict[frozenset, Mapping | None] = {}

    def mapping_of(record) -> Mapping | None:
        if not isinstance(record, dict):
            return None
        paths = frozenset(field_paths(record) & known)
        if paths not in prints:
            prints[paths] = by_print.get(fingerprint(set(paths)))
        return prints[paths]

    def run(batches):
        for b in batches:
            at, rows = [], []
            for i, text in enumerate(b.column("record").to_pylist()):
                try:
                    record = json.loads(text) if text is not None else None
                except ValueError:
                    record = None
                m = mapping_of(record)
                try:
                    turns = [(*t, m.name, None) for t in record_turns(record, m)] if m else None
                except (ValueError, TypeError):
                    turns = None
                turns = [(None, None, None, None, text)] if turns is None else turns
                at += [i] * len(turns)
                rows += turns
            turn, role, said, layout, unknown = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id").take(pa.array(at, pa.int64())), pa.array(turn, pa.int64()),
                 pa.array(role, pa.string()), pa.array(said, pa.string()),
                 pa.array(layout, pa.string()), pa.array(unknown, pa.string())],
                ["conv_id", "turn", "role", "text", "layout", "unknown"])

    return records.select("conv_id", "record").mapInArrow(
        run, f"conv_id {kind}, turn long, role string, text string, layout string, unknown string")


def rows_as_records(rows: DataFrame) -> DataFrame:
    """A table with a row per turn as records of the row layout."""
    record = F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"})
    return rows.select("conv_id", record.alias("record"))


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, segment, loss_start, loss_chars, unknown; segments make a conversation.

    ``<`` before bars gets one bar more, so ``<|`` with a single bar only ever opens a control
    string; in roles, line breaks are escaped as well. The loss mask covers the escaped text
    of assistant turns and nothing else. Ties of a turn are ordered by role and text. A record
    that has no turns stays as a row without a segment, with the record in ``unknown``.
    """
    escaped = F.regexp_replace(F.coalesce("text", F.lit("")), "<(\\|+)", "<|$1")
    role = F.regexp_replace(F.coalesce("role", F.lit("")), "<(\\|+)", "<|$1")
    role = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    formed = F.col("layout").isNotNull()
    named = turns.select("conv_id", "turn", "role", "text", "unknown", formed.alias("formed"),
                         role.alias("r"), escaped.alias("t"))
    segment = F.concat(F.lit(START), "r", F.lit("\n"), "t", F.lit(END + "\n"))
    segment = F.when(F.col("formed"), segment)
    mask = F.col("formed") & (F.col("role") == "assistant")
    start = F.when(mask, F.length("r") + len(START) + 1)
    ordered = named.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "turn", segment.alias("segment"), start.alias("loss_start"),
                          F.when(mask, F.length("t")).alias("loss_chars"), "unknown")


def unescaped(text: str) -> str:
    return re.sub(r"<\|(\|+)", r"<\1", text)


def read_segment(segment: str) -> tuple[str, str]:
    """Role and text of a segment."""
    m = _SEGMENT.fullmatch(segment)
    role = re.sub(r"\\(.)", lambda x: "\n" if x[1] == "n" else x[1], m[1])
    return unescaped(role), unescaped(m[2])


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from the formatted output, one row per conversation.

    ``n_unknown`` counts its records that have no turns; nothing else comes of them.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars",
             "n_unknown"]

    def run(batches):
        at, state, id_type = None, None, None

        def row():
            n, turns, chars, loss, length, unknown = state
            values = [at, n, turns.hexdigest(), chars, loss.hexdigest(), length, unknown]
            kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(),
                     pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        done: list[pa.RecordBatch] = []
        for b in batches:
            id_type = b.column("conv_id").type
            for conv, segment, start, n in zip(*(b.column(c).to_pylist() for c in (
                    "conv_id", "segment", "loss_start", "loss_chars")), strict=True):
                if state is None or conv != at:
                    if state is not None:
                        done.append(row())
                    at, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                if segment is None:
                    state[5] += 1
                    continue
                role, text = read_segment(segment)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    under = unescaped(segment[start:start + n])
                    state[2] += len(under)
                    state[3].update(under.encode())
                state[4] += len(segment)
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                done = []
        if state is not None:
            yield row()

    return formatted.mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
             "loss_sha256 string, formatted_chars long, n_unknown long")
