"""What several corpus operators share: words, text bytes, the write that cuts lineage."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.session import landed
from tidecast.sources.tables import table

#: A word is a run of characters other than these six; ``bytes.split()`` cuts at the same six.
WORD = "[^\\x20\\x09-\\x0D]+"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

__all__ = ["WORD", "ascii_lower", "column", "column_of", "key_of", "key_struct", "landed",
           "n_words", "only_rows_of", "packed", "row_order", "spare", "table", "text_of", "texts",
           "unpacked", "word_blocks"]


def text_of(column: str = "text") -> Column:
    """The text, a null one as an empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, _UPPER, _LOWER)


def key_of(text: Column) -> Column:
    """Tells apart rows that share an id but not a text."""
    return F.xxhash64(text)


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """UTF-8 bytes of a string column, nulls as empty texts, one at a time."""
    for value in batch.column(column).cast(pa.binary()):
        yield value.as_py() or b""


def column_of(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).to_pylist()


def word_blocks(text: bytes, keep: int = 0, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in blocks, so that a very long text never becomes one list.

    From the second block on, a block starts with the last ``keep`` words before it.
    """
    start, tail = 0, []
    while start < len(text):
        cut = _SPACE.search(text, start + size)
        end = cut.start() if cut else len(text)
        words = tail + text[start:end].split()
        yield words
        tail = words[-keep:] if keep else []
        start = end


def packed(docs: DataFrame, *more: str) -> DataFrame:
    """``key`` (of doc_id, text_key and ``more``) and ``row``, the row as one column.

    The fields of both have names of their own, so whatever the columns of ``docs`` are
    called, none can meet a helper's. Keys with the same nulls are equal.
    """
    fields = [column(n).alias(f"c{i}") for i, n in enumerate(docs.columns)]
    keyed = docs.select(F.struct(*fields).alias("row"), "doc_id", key_of(text_of()).alias("text_key"),
                        *[column(n).alias(f"k{i}") for i, n in enumerate(more)])
    return keyed.select(key_struct("doc_id", "text_key", *[f"k{i}" for i in range(len(more))]), "row")


def key_struct(*names: str) -> Column:
    return F.struct(*[F.col(n).alias(f"k{i}") for i, n in enumerate(names)]).alias("key")


def unpacked(rows: DataFrame, names: list[str], *more: Column) -> DataFrame:
    """The rows of ``packed`` again, under the names they had."""
    return rows.select(*[F.col(f"row.c{i}").alias(n) for i, n in enumerate(names)], *more)


def column(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def spare(names: list[str], wanted: str) -> str:
    """The wanted name, or the first longer one that no column has in any spelling."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def row_order(docs: DataFrame, without: str | None = None) -> Column:
    """A hash of all that can be hashed of a packed row: which of several comes first."""
    hashed = [F.col(f"row.c{i}") for i, f in enumerate(docs.schema.fields)
              if f.name != without and not re.search("map<|variant", f.dataType.simpleString())]
    return F.xxhash64(*hashed)


def only_rows_of(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (id, text) is in ``keep``, one of each, columns as they were.

    ``keep`` has ``doc_id`` and ``text_key``. Of rows that share both but differ elsewhere the
    one with the smallest hash stays, so that runs agree.
    """
    joined = packed(docs).join(keep.select(key_struct("doc_id", "text_key")).distinct(), "key",
                               "left_semi")
    first = joined.groupBy("key").agg(F.min_by("row", row_order(docs)).alias("row"))
    return unpacked(first, docs.columns)
