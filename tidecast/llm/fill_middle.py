"""Fill-in-middle: a text is cut twice between code points and its parts change places.

Where the cuts fall is found on the bytes, eight at a time. A whole batch of texts is viewed
as 64-bit words; in each word the bytes that end a code point are marked by shifts and masks
(a byte ends one if the next byte continues none), the marks are counted per word by
``bitwise_count`` and summed along the words. The byte at which the k-th code point of a text
ends then lies in the word that a search in these sums gives, at the mark left after the
lower ones of the word are cleared. No text is decoded or walked through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1"
#: Of 100 texts, so many stay plain, and of the others so many start with the suffix.
PLAIN_PERCENT, SPM_PERCENT = 10, 20

_ONES = np.uint64(0x0101010101010101)
_LOW = np.uint64(1)


def unit_ends(data: np.ndarray) -> np.ndarray:
    """One word per eight bytes, with the lowest bit of each byte set that ends a code point.

    The last byte given ends one. Bytes that no code point starts with belong to the one
    before them.
    """
    n = len(data)
    padded = np.zeros((n + 15) // 8 * 8, dtype=np.uint8)
    padded[:n] = data
    words = padded.view("<u8")
    after = (words[:-1] >> np.uint64(8)) | (words[1:] << np.uint64(56))  # each byte's next byte
    goes_on = (after >> np.uint64(7)) & ~(after >> np.uint64(6)) & _ONES
    ends = ~goes_on & _ONES
    if n % 8:
        ends[-1] &= (_LOW << np.uint64(8 * (n % 8))) - _LOW
    return ends


class Units:
    """Code points of a stretch of UTF-8: how many end up to a byte, and where the k-th ends."""

    def __init__(self, data: np.ndarray):
        self.ends = unit_ends(data)
        self.sums = np.concatenate([[0], np.cumsum(np.bitwise_count(self.ends), dtype=np.int64)])

    def before(self, byte: np.ndarray) -> np.ndarray:
        """Code points that end among the bytes before this one."""
        word, rest = byte // 8, (byte % 8).astype(np.uint64)
        whole = np.append(self.ends, np.uint64(0))[word]
        part = whole & ((_LOW << (np.uint64(8) * rest)) - _LOW)
        return self.sums[word] + np.bitwise_count(part)

    def end_of(self, k: np.ndarray) -> np.ndarray:
        """The byte after the k-th code point, counted from 1; 0 for none."""
        if not len(self.ends):
            return np.zeros(len(k), dtype=np.int64)
        word = np.maximum(np.searchsorted(self.sums, k, side="left") - 1, 0)
        left, marks = k - self.sums[word] - 1, self.ends[word].copy()
        for step in range(7):  # a word has at most eight marks
            lower = left > step
            marks[lower] &= marks[lower] - _LOW
        lowest = marks & (~marks + _LOW)
        at = np.bitwise_count(lowest - _LOW).astype(np.int64) // 8
        return np.where(k > 0, word * 8 + at + 1, 0)


def _cut_points(column: pa.Array, first: np.ndarray, second: np.ndarray):
    """Of each text its bytes' start and end in the buffer, the two cuts, and its code points.

    ``first`` and ``second`` are random numbers; a cut is one of them modulo (n + 1).
    """
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int32)[
        column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw else np.zeros(0, dtype=np.uint8)
    data = data[bounds[0]:bounds[-1]]
    units = Units(data)
    start, end = bounds[:-1] - bounds[0], bounds[1:] - bounds[0]
    base = units.before(start)
    n = units.before(end) - base
    x, y = first % (n + 1), second % (n + 1)
    low, high = np.minimum(x, y), np.maximum(x, y)
    cut = [np.where(k > 0, units.end_of(base + k), start) for k in (low, high)]
    return data, start, end, cut, n, low, high - low


def _draws(seed: str) -> list[Column]:
    """Four numbers below 2^32 from the hash of the seed and the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    digest = F.sha2(text.cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, seed: str = SEED, plain_percent: int = PLAIN_PERCENT,
              spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row.

    A text of n code points is cut after two of them drawn by the id; ``form`` is psm (prefix,
    suffix, middle), spm (suffix, prefix, middle), or plain, where the text stays as it is and
    the two lengths are null. Empty texts, null ones among them, and texts that hold one of
    the three marks are plain, so that a form can always be read back. A null id draws like an
    empty one; rows that repeat an id are cut by the same numbers, each its own text. Other
    columns play no part.
    """
    h1, h2, h3, h4 = _draws(seed)
    text = text_of()
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(mark))
    plain = (text == "") | marked | (h3 % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    rows = docs.select("doc_id", text.alias("text"), h1.alias("h1"), h2.alias("h2"),
                       form.alias("form"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def run(batches):
        for b in batches:
            forms = b.column("form").to_pylist()
            data, start, end, (one, two), n, before, between = _cut_points(
                b.column("text").cast(pa.string()), b.column("h1").to_numpy(),
                b.column("h2").to_numpy())
            whole, out = data.tobytes(), []
            for f, i, j, k, z in zip(forms, start.tolist(), one.tolist(), two.tolist(),
                                     end.tolist(), strict=True):
                if f == "plain":
                    out.append(whole[i:z])
                elif f == "psm":
                    out.append(b"".join((p, whole[i:j], s, whole[k:z], m, whole[j:k])))
                else:
                    out.append(b"".join((s, whole[k:z], p, whole[i:j], m, whole[j:k])))
            plain = np.array([f == "plain" for f in forms], dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n), b.column("form"), pa.array(before, mask=plain),
                 pa.array(between, mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, f"doc_id {id_type}, n long, form string, prefix_chars long, "
                                "middle_chars long, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text again, from an output and its form."""
    parts = F.split(F.col(output), f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(F.col(form) == "psm", F.concat(part(1), part(3), part(2))).when(
        F.col(form) == "spm", F.concat(part(2), part(3), part(1))).otherwise(F.col(output))
