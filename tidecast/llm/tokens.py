"""Documents as chunks of word numbers, and counts looked up across chunks.

A chunk is a row: about a million words of whole documents, each word a number in the
chunk's own list of words. To learn how often something occurs in the corpus, each chunk
asks once for each distinct hash it holds; questions go to buckets by the hash's first bits,
and an answer is a number per question, in the order asked. A frequent thing is asked for
once by each chunk, however often it occurs, so no bucket is hot.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import landed, texts, word_blocks

CHUNK_WORDS = 1 << 20
#: Questions that one bucket answers.
BUCKET_ROWS = 1 << 20


#: Base of the sums that n-gram hashes are read from, and its inverse modulo 2^64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def pack(values: np.ndarray) -> bytes:
    """Whole numbers, seven bits to a byte."""
    v = np.asarray(values, np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        more = v >= np.uint64(1 << (7 * k))
        if not more.any():
            break
        size += more
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        m = size > k
        part = ((v[m] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8)
        out[start[m] + k] = part | ((size[m] > k + 1).astype(np.uint8) << 7)
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    size = ends - starts + 1
    out = np.zeros(len(ends), np.uint64)
    for k in range(int(size.max(initial=0))):
        m = size > k
        out[m] |= (b[starts[m] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return out.astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers stirred, so that any of them serve as a hash."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Chunk:
    """Words of a chunk row: ``ids`` into ``words``, and where each document lies."""

    def __init__(self, lengths, vocab: bytes, tokens: bytes):
        self.lengths = np.asarray(lengths, np.int64)
        self.words = vocab.split(b"\n") if vocab else []
        self.ids = unpack(tokens)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths

    def hashes(self) -> np.ndarray:
        known = np.array([xxhash.xxh64_intdigest(w) for w in self.words], np.uint64)
        return known[self.ids] if len(known) else np.zeros(0, np.uint64)

    def ngrams(self, hashes: np.ndarray, n: int) -> np.ndarray:
        """Hash of the n words from each position on, also across the ends of documents."""
        size = max(len(hashes) - n + 1, 0)
        power = np.full(len(hashes), _BASE)
        power[:1] = 1
        power = np.cumprod(power)  # all arithmetic is modulo 2^64
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power)])
        back = np.full(size, _BACK)
        back[:1] = 1
        return mixed((sums[n:] - sums[:size]) * np.cumprod(back) + np.uint64(n))

    def inside(self, n: int) -> np.ndarray:
        """Positions whose n words all belong to one document."""
        left = np.repeat(self.ends, self.lengths) - np.arange(len(self.ids))
        return np.flatnonzero(left >= n)


def chunked(docs: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """chunk, ids (of documents), lengths, vocab, tokens; written to the shared folder.

    The write fixes which documents form a chunk, whatever is computed again later. A
    document is never split. Null texts have no words.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["chunk", "ids", "lengths", "vocab", "tokens"]

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        ids, lengths, parts, total, id_type = [], [], [], 0, None

        def row():
            tokens = pack(np.concatenate(parts) if parts else np.zeros(0, np.uint32))
            values = [[(task << 32) + made], [ids], [lengths], [b"\n".join(number)], [tokens]]
            types = [pa.int64(), pa.list_(id_type), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(values, types, strict=True)], names)

        for b in batches:
            id_type = b.column("doc_id").type
            for doc_id, text in zip(b.column("doc_id").to_pylist(), texts(b), strict=True):
                n = 0
                for words in word_blocks(text):
                    parts.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
                    n += len(words)
                ids.append(doc_id)
                lengths.append(n)
                total += n
                if total >= chunk_words or len(ids) >= chunk_words:
                    yield row()
                    made += 1
                    number.clear()
                    ids, lengths, parts, total = [], [], [], 0
        if ids:
            yield row()

    return landed(docs.select("doc_id", "text").mapInArrow(
        run, f"chunk long, ids array<{kind}>, lengths array<int>, vocab binary, tokens binary"),
        "chunks")


def bucket_bits(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """First bits of a hash that make up a bucket, so that each has about ``bucket_rows``."""
    return max(1, int(np.ceil(np.log2(max(rows, 1) / bucket_rows + 1))))


def questions(chunks: DataFrame, ask: Callable[[Chunk], dict[int, np.ndarray]], bits: int):
    """bucket, chunk, slot, hashes, counts: what each chunk wants counted.

    ``ask`` gives the hashes of each slot, one for each occurrence.
    """
    names = ["bucket", "chunk", "slot", "hashes", "counts"]

    def run(batches):
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        for b in batches:
            for row in rows_of(b, 1):
                for slot, hashes in ask(Chunk(row["lengths"], row["vocab"], row["tokens"])).items():
                    found, counts = np.unique(hashes, return_counts=True)
                    cuts = np.searchsorted(found, edges)
                    parts = list(zip(np.split(found, cuts), np.split(counts, cuts), strict=True))
                    some = [i for i, (h, _) in enumerate(parts) if len(h)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some, pa.int32()), pa.array([row["chunk"]] * len(some), pa.int64()),
                         pa.array([slot] * len(some), pa.int32()),
                         pa.array([parts[i][0].tobytes() for i in some], pa.binary()),
                         pa.array([pack(parts[i][1]) for i in some], pa.binary())], names)

    return chunks.select("chunk", "lengths", "vocab", "tokens").mapInArrow(
        run, "bucket int, chunk long, slot int, hashes binary, counts binary")


def answers(asked: DataFrame) -> DataFrame:
    """chunk, slot, bucket, totals: for each question the count over all chunks."""
    names = ["chunk", "slot", "bucket", "totals"]

    def run(batches):
        for bucket, rows in grouped(batches, "bucket"):
            hashes = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
            own = np.concatenate([unpack(r["counts"]) for r in rows])
            _, at = np.unique(np.concatenate(hashes), return_inverse=True)
            totals = np.bincount(at, own)[at].astype(np.int64)
            parts = np.split(totals, np.cumsum([len(h) for h in hashes])[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["chunk"] for r in rows], pa.int64()),
                 pa.array([r["slot"] for r in rows], pa.int32()),
                 pa.array([bucket] * len(rows), pa.int32()),
                 pa.array([pack(p) for p in parts], pa.binary())], names)

    return asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        run, "chunk long, slot int, bucket int, totals binary")


def rows_of(batch: pa.RecordBatch, some: int) -> Iterator[dict]:
    """Rows of a batch as Python values, some at a time, since rows are large."""
    for i in range(0, batch.num_rows, some):
        yield from batch.slice(i, some).to_pylist()


def grouped(batches, key: str) -> Iterator[tuple[object, list[dict]]]:
    """Runs of rows with one key, of rows that come sorted by it."""
    at, rows = None, []
    for b in batches:
        for row in rows_of(b, 256):
            if rows and row[key] != at:
                yield at, rows
                rows = []
            at = row[key]
            rows.append(row)
    if rows:
        yield at, rows


def answered(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """Chunk rows with their answers: an array of (slot, bucket, totals)."""
    per_chunk = found.groupBy("chunk").agg(
        F.collect_list(F.struct("slot", "bucket", "totals")).alias("answers"))
    return chunks.join(per_chunk, "chunk", "left")


def totals_of(answers: list[dict] | None, slot: int) -> np.ndarray:
    """Counts of a slot's distinct hashes, in the order of the hashes."""
    parts = sorted((a for a in answers or [] if a["slot"] == slot), key=lambda a: a["bucket"])
    return np.concatenate([np.zeros(0, np.int64), *(unpack(a["totals"]) for a in parts)])
