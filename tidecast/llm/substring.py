"""Removal of passages that occur more than once, found with FM-indexes.

To stream every document past the index of every shard would take shards times documents.
Instead, what can match is brought to one shard: each window of words has an anchor, the
smallest of the hashes of its short word runs, and equal windows have equal anchors. The
windows around one anchor make a segment. Chunks ask how often each anchor occurs; segments
around an anchor that occurs once hold no repeated window and go nowhere. The others go to
the shard of their anchor, where equal segments are repeated passages, and the rest is
indexed and searched backward for its matching statistics. An anchor with very many
occurrences is split: its windows go one by one to the shard of their own hash, where each
meets only its equals.

Shards compare words, not hashes, so a collision costs time and never a word.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import landed
from tidecast.llm.fm_index import FMIndex, repeated_windows
from tidecast.llm.tokens import (BUCKET_ROWS, CHUNK_WORDS, Chunk, answered, answers, bucket_bits,
                                 chunked, grouped, pack, questions, rows_of, totals_of, unpack)

WINDOW = 35
ANCHOR_WORDS = 12
#: Words of the corpus for each shard, and occurrences from which an anchor is split.
SHARD_WORDS = 1 << 21
HOT_ANCHOR = 20_000
_PLACE = np.uint64((1 << 28) - 1)


def anchors(c: Chunk, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the position of each one's anchor, and the hash of every run."""
    starts = c.inside(window)
    hashes = c.ngrams(c.hashes(), run)
    if not len(starts):
        return starts, starts, hashes
    runs = window - run + 1
    low = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= runs:  # smallest of ``width`` hashes from each position on
        low = np.minimum(low[:len(low) - width], low[width:])
        width *= 2
    best = np.minimum(low[starts], low[starts + runs - width])
    return starts, (best & _PLACE).astype(np.int64), hashes


def _ask(window: int, run: int):
    def ask(c: Chunk) -> dict[int, np.ndarray]:
        _, at, hashes = anchors(c, window, run)
        return {0: hashes[np.unique(at)]}

    return ask


def segments(c: Chunk, totals: np.ndarray, window: int, run: int, shards: int, hot: int):
    """(shard, anchor, segment, starts) of all windows whose anchor occurs more than once."""
    starts, at, hashes = anchors(c, window, run)
    found = np.unique(hashes[np.unique(at)])
    times = totals[np.searchsorted(found, hashes[at])] if len(at) else at
    cut = np.flatnonzero(np.diff(at) | (np.diff(starts) != 1)) + 1
    first = np.concatenate([[0], cut]).astype(np.int64) if len(at) else cut
    last = np.concatenate([cut, [len(at)]])[:len(first)] - 1
    some = times[first] >= 2 if len(first) else np.zeros(0, bool)
    ids, words = c.ids.tolist(), c.words
    out: dict[tuple[int, int, bytes], list[int]] = defaultdict(list)
    for a, b in zip(first[some].tolist(), last[some].tolist(), strict=True):
        s, e, anchor = int(starts[a]), int(starts[b]), int(hashes[at[a]])
        if times[a] > hot:
            for w in range(s, e + 1):
                text = b" ".join([words[i] for i in ids[w:w + window]])
                own = xxhash.xxh64_intdigest(text)
                out[own % shards, own, text].append(w)
        else:
            text = b" ".join([words[i] for i in ids[s:e + window]])
            out[anchor % shards, anchor, text].append(s)
    return out


def shard_spans(rows: list[tuple[int, bytes, int, list[int]]], window: int,
                run: int) -> dict[int, list[tuple[int, int]]]:
    """By chunk, the (first window, number of windows) that are repeated.

    ``rows`` are (anchor, segment, chunk, starts). A segment that occurs twice is repeated
    as a whole. One that occurs once is searched in the index of all different segments
    around its anchors.
    """
    times, kinds = Counter(), defaultdict(set)
    for anchor, text, _, starts in rows:
        times[text] += len(starts)
        kinds[anchor].add(text)
    spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
    texts = list({t for group in kinds.values() if len(group) > 1 for t in group})
    single = {t: i for i, t in enumerate(texts) if times[t] == 1}
    where = {}
    for _, text, chunk, starts in rows:
        if times[text] > 1:
            n = text.count(b" ") + 2 - window
            spans[chunk] += [(s, n) for s in starts]
        elif text in single:
            where[single[text]] = (chunk, starts[0])
    if single:
        number = defaultdict()
        number.default_factory = lambda: len(number) + 1
        parts = []
        for text in texts:
            words = text.split(b" ")
            parts.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        lengths = np.array([len(p) for p in parts])
        whole = np.concatenate([x for p in parts for x in (p, np.zeros(1, np.int64))])
        begins = np.cumsum(lengths + 1) - lengths - 1
        asked = np.array(sorted(single.values()))
        index = FMIndex(whole, 2 * window - run + 1)
        for who, first, n in repeated_windows(index, whole, begins[asked], lengths[asked], window):
            for i, a, k in zip(asked[who].tolist(), first.tolist(), n.tolist(), strict=True):
                chunk, s = where[i]
                spans[chunk].append((s + a, k))
    return spans


def _kept(c: Chunk, starts: np.ndarray, counts: np.ndarray, window: int):
    """Of each document the words removed, and the digest of those kept."""
    edge = np.zeros(len(c.ids) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + counts - 1 + window, -1)
    gone = np.cumsum(edge)[:-1] > 0
    removed, digests = [], []
    for a, b in zip(c.starts.tolist(), c.ends.tolist(), strict=True):
        kept = c.ids[a:b][~gone[a:b]].tolist()
        removed.append(b - a - len(kept))
        digests.append((kept, hashlib.sha256(b" ".join([c.words[i] for i in kept])).hexdigest()))
    return removed, digests


def repeated_passages(docs: DataFrame, window: int = WINDOW, anchor_words: int = ANCHOR_WORDS,
                      chunk_words: int = CHUNK_WORDS, shard_words: int = SHARD_WORDS,
                      hot_anchor: int = HOT_ANCHOR, bucket_rows: int = BUCKET_ROWS,
                      with_text: bool = False) -> DataFrame:
    """Of every row: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    A word goes if a window over it has the same words as a window anywhere else, in the
    same document too; windows are those of the input. Null texts have no words; texts
    shorter than a window lose none. A repeated row is a document of its own, so both it
    and its copy lose their windows. Null ids and further columns make no difference.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    chunks = chunked(docs, chunk_words)
    words = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    total = int(chunks.agg(F.coalesce(F.sum(words), F.lit(0))).first()[0])
    shards = max(1, -(-total // shard_words))
    bits = bucket_bits(total // 8, bucket_rows)
    counts = landed(answers(questions(chunks, _ask(window, anchor_words), bits)), "anchors")

    def send(batches):
        names = ["shard", "anchor", "chunk", "segment", "starts"]
        for b in batches:
            for row in rows_of(b, 1):
                c = Chunk(row["lengths"], row["vocab"], row["tokens"])
                out = segments(c, totals_of(row["answers"], 0), window, anchor_words, shards,
                               hot_anchor)
                keys = list(out)
                for i in range(0, len(keys), 20_000):
                    some = keys[i:i + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k[0] for k in some], pa.int64()),
                         pa.array(np.array([k[1] for k in some], np.uint64).view(np.int64)),
                         pa.array([row["chunk"]] * len(some), pa.int64()),
                         pa.array([k[2] for k in some], pa.binary()),
                         pa.array([out[k] for k in some], pa.list_(pa.int32()))], names)

    sent = answered(chunks, counts).select("chunk", "lengths", "vocab", "tokens", "answers")
    sent = sent.mapInArrow(
        send, "shard long, anchor long, chunk long, segment binary, starts array<int>")

    def search(batches):
        for _, rows in grouped(batches, "shard"):
            spans = shard_spans([(r["anchor"], r["segment"], r["chunk"], r["starts"])
                                 for r in rows], window, anchor_words)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(spans), pa.int64()),
                 pa.array([pack([s for s, _ in v]) for v in spans.values()], pa.binary()),
                 pa.array([pack([n for _, n in v]) for v in spans.values()], pa.binary())],
                ["chunk", "starts", "counts"])

    spans = landed(sent.repartition("shard").sortWithinPartitions("shard").mapInArrow(
        search, "chunk long, starts binary, counts binary"), "spans")
    spans = spans.groupBy("chunk").agg(F.collect_list(F.struct("starts", "counts")).alias("spans"))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text

    def finish(batches):
        for b in batches:
            ids = b.column("ids")
            for i, row in enumerate(rows_of(b.drop_columns(["ids"]), 1)):
                c = Chunk(row["lengths"], row["vocab"], row["tokens"])
                none = np.zeros(0, np.int64)
                starts = np.concatenate([none, *(unpack(s["starts"]) for s in row["spans"] or [])])
                n = np.concatenate([none, *(unpack(s["counts"]) for s in row["spans"] or [])])
                removed, kept = _kept(c, starts, n, window)
                columns = [ids[i].values, pa.array(c.lengths), pa.array(removed, pa.int64()),
                           pa.array([d for _, d in kept], pa.string())]
                if with_text:
                    columns.append(pa.array([b" ".join([c.words[j] for j in k]).decode()
                                             for k, _ in kept], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string"
    joined = chunks.join(spans, "chunk", "left").select("ids", "lengths", "vocab", "tokens", "spans")
    return joined.mapInArrow(finish, schema + ", kept_text string" * with_text)
