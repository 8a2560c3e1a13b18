"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside them.

Vectors are compared only when their labels are equal. Equal vectors are one before anything
is compared. Each vector belongs to the cell of its nearest centre and is a guest of every
other cell that a partner may belong to: a partner lies on the far side of the plane between
two centres, so a vector farther from that plane than the angle of the threshold has none
there. No link is lost, whatever the centres are; they only decide how much is compared.

A cell is dealt to blocks, and two blocks at a time meet in a task, which compares them by
products of some rows each and returns a row per vector: how many it is linked to, and the
first of its class. Pairs are never rows.
"""

from __future__ import annotations

from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import landed
from tidecast.llm.simhash import components

COSINE = 0.98
#: Vectors of one label for which there is one cell more, and the most cells.
CELL_ROWS, MOST_CELLS = 2048, 512
#: Vectors of each length that the centres are fitted to, and how often they are moved.
SAMPLE_ROWS, ROUNDS = 20_000, 10
#: Numbers that one block may hold, and the blocks of a cell that is smaller than that.
BLOCK_NUMBERS, BLOCKS = 1 << 20, 8
LEAST_BLOCK = 2048
_ROWS = 256
_SLACK = 1e-9


def _matrix(column: pa.Array, dtype: str) -> np.ndarray:
    """Rows of equal length in doubles, at unit length."""
    flat = np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).astype(np.float64)
    found = flat.reshape(len(column), -1)
    found = found / np.abs(found).max(axis=1, keepdims=True)
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def _usable(column: pa.Array, dtype: str) -> list[bytes | None]:
    """The bytes of each vector, None where it has nothing to compare."""
    bounds = column.offsets.to_numpy().astype(np.int64)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    found = []
    for i, there in enumerate(column.is_valid().to_pylist()):
        v = values[bounds[i]:bounds[i + 1]]
        fit = there and len(v) and np.isfinite(v).all() and v.any()
        found.append((v + 0.0).astype(dtype).tobytes() if fit else None)
    return found


def _read(vectors: DataFrame) -> tuple[DataFrame, str]:
    """vec_id, label, dim, vector (its bytes) and node, a hash of the three, or nulls."""
    kinds = {f.name: f.dataType for f in vectors.schema.fields}
    single = kinds["embedding"].elementType.typeName() == "float"
    dtype, width = ("<f4", 4) if single else ("<f8", 8)
    id_type, label_type = (kinds[c].simpleString() for c in ("vec_id", "label"))

    def run(batches):
        for b in batches:
            found = pa.array(_usable(b.column("embedding"), dtype), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("label"), found], ["vec_id", "label", "vector"])

    rows = vectors.select("vec_id", "label", "embedding").mapInArrow(
        run, f"vec_id {id_type}, label {label_type}, vector binary")
    rows = rows.withColumn("vector", F.when(F.col("label").isNotNull(), F.col("vector")))
    dim = (F.octet_length("vector") / width).cast("int")
    name = F.concat(F.concat(dim, F.lit(",")).cast("binary"), "vector",
                    F.col("label").cast("string").cast("binary"))
    return rows.select("vec_id", "label", dim.alias("dim"), "vector",
                       F.unhex(F.md5(name)).alias("node")), dtype


def spherical_k_means(points: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of unit length; a cell that stays empty takes the worst served point."""
    centres = points[:k].copy()
    for _ in range(rounds):
        near = points @ centres.T
        home = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, points)
        empty = np.flatnonzero(np.bincount(home, minlength=len(centres)) == 0)
        if len(empty):
            sums[empty] = points[np.argsort(near.max(axis=1))[:len(empty)]]
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


def fit_cells(distinct: DataFrame, dtype: str, cell_rows: int = CELL_ROWS,
              most_cells: int = MOST_CELLS, sample_rows: int = SAMPLE_ROWS) -> dict[int, np.ndarray]:
    """Centres for each length of vector whose largest label has more than ``cell_rows``.

    They are fitted to at most ``sample_rows`` vectors of that length, those of smallest hash.
    """
    sizes = distinct.groupBy("dim", "label").agg(F.count("*").alias("n"))
    large = sizes.groupBy("dim").agg(F.max("n").alias("n")).where(F.col("n") > cell_rows)
    found = {}
    for r in sorted(large.collect()):
        some = distinct.where(F.col("dim") == r["dim"]).select("node", "vector").orderBy(
            F.xxhash64("node"), "node").limit(sample_rows).toArrow()
        points = _matrix(some["vector"].combine_chunks(), dtype)
        k = min(ceil(r["n"] / cell_rows), most_cells, len(points))
        found[r["dim"]] = spherical_k_means(points, k)
    return found


def cells_of(points: np.ndarray, centres: np.ndarray, cosine: float) -> np.ndarray:
    """A row per point and cell: 2 at home, 1 a guest, 0 not there.

    Of two cells only one takes the other's vectors as guests, so that a pair meets once.
    """
    near = points @ centres.T
    home = near.argmax(axis=1)
    apart = np.linalg.norm(centres[:, None] - centres[None], axis=2)
    above = near[np.arange(len(points)), home][:, None] - near  # times the centres' distance
    reach = sqrt(max(1 - cosine * cosine, 0.0)) if cosine > 0 else 2.0
    close = above <= reach * apart[home] + _SLACK
    j, i = np.arange(len(centres))[None], home[:, None]
    found = (close & (((i + j) % 2 == 0) == (j < i))).astype(np.int8)
    found[np.arange(len(points)), home] = 2
    return found


def placed(distinct: DataFrame, centres: dict[int, np.ndarray], dtype: str, cosine: float,
           carry: list[str]) -> DataFrame:
    """``carry``, cell and own: a row for each cell that a vector is at home or a guest in."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}"
                       for f in distinct.select(*carry).schema.fields)

    def run(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            at, cell, own = [], [], []
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                if int(dim) not in centres:
                    at.append(rows)
                    cell.append(np.zeros(len(rows), dtype=np.int32))
                    own.append(np.ones(len(rows), dtype=bool))
                    continue
                for some in np.split(rows, range(_ROWS, len(rows), _ROWS)):
                    points = _matrix(b.column("vector").take(pa.array(some)), dtype)
                    found = cells_of(points, centres[int(dim)], cosine)
                    i, j = np.nonzero(found)
                    at.append(some[i])
                    cell.append(j.astype(np.int32))
                    own.append(found[i, j] == 2)
            if at:
                take = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).take(take) for c in carry), pa.array(np.concatenate(cell)),
                     pa.array(np.concatenate(own))], [*carry, "cell", "own"])

    return distinct.select(*dict.fromkeys([*carry, "dim", "vector"])).mapInArrow(
        run, f"{fields}, cell int, own boolean")


class Classes:
    """Which of some rows reach each other; the first row of a class stands for it."""

    def __init__(self, n: int):
        self.top = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.top[a], self.top[b]
            open_ = a != b
            if not open_.any():
                return
            pairs = np.unique(np.stack([np.maximum(a, b)[open_], np.minimum(a, b)[open_]]), axis=1)
            a, b = pairs
            np.minimum.at(self.top, a, b)
            while True:
                up = self.top[self.top]
                if (up == self.top).all():
                    break
                self.top = up


def compare(points: np.ndarray, own: np.ndarray, first: np.ndarray, copies: np.ndarray,
            cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each row how many rows it is linked to, copies counted, and the first of its class.

    ``first`` marks the rows of the first block; they are compared with those of the second,
    or with each other where there is none. Two guests are never compared.
    """
    left = np.flatnonzero(first)
    right = np.flatnonzero(~first)
    same = not len(right)
    right = left if same else right
    linked, classes = np.zeros(len(points)), Classes(len(points))
    other, weight = points[right].T, copies.astype(np.float64)
    for at in range(0, len(left), _ROWS):
        some = left[at:at + _ROWS]
        near = points[some] @ other >= cosine
        near &= own[some][:, None] | own[right][None]
        if same:
            near[np.arange(len(some)), np.arange(at, at + len(some))] = False
        if not near.any():
            continue
        linked[some] += near @ weight[right]
        if not same:
            linked[right] += near.T @ weight[some]
        i, j = np.nonzero(near)
        classes.join(some[i], right[j])
    return linked.astype(np.int64), classes.top


def links(distinct: DataFrame, dtype: str, cosine: float = COSINE, cell_rows: int = CELL_ROWS,
          **options) -> DataFrame:
    """(node, linked, root): vectors that a block links, to how many rows, and to which class."""
    centres = fit_cells(distinct, dtype, cell_rows, **options)
    unit = ["label", "dim", "cell"]
    slim = placed(distinct, centres, dtype, cosine, ["label", "dim"])
    sizes = slim.groupBy(*unit).agg(F.count("*").alias("n"), F.count_if("own").alias("own"))
    fits = F.greatest(F.floor(F.lit(BLOCK_NUMBERS) / F.col("dim")), F.lit(1))
    size = F.least(fits, F.greatest(F.ceil(F.col("n") / BLOCKS), F.lit(LEAST_BLOCK)))
    sizes = landed(sizes.where("n > 1 AND own > 0").select(
        *unit, F.ceil(F.col("n") / size).cast("int").alias("blocks")), "cells")
    rows = placed(distinct, centres, dtype, cosine, ["label", "dim", "node", "copies", "vector"])
    rows = rows.join(sizes, unit)
    block = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
    rows = rows.withColumn("block", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("low", F.least("block", "other")).withColumn(
        "high", F.greatest("block", "other"))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node = table["node"].combine_chunks()
        first = pc.equal(table["block"], table["low"]).to_numpy()
        if not first.all() or table["low"][0].equals(table["high"][0]):
            linked, top = compare(
                _matrix(table["vector"].combine_chunks(), dtype), table["own"].to_numpy(), first,
                table["copies"].to_numpy(), cosine)
        else:
            linked, top = np.zeros(len(node), dtype=np.int64), np.arange(len(node))
        found = pa.array(np.flatnonzero(linked))
        return pa.table({"node": node.take(found), "linked": pa.array(linked).take(found),
                         "root": node.take(pa.array(top)).take(found)})

    meet = rows.select(*unit, "low", "high", "block", "own", "node", "copies", "vector")
    return meet.groupBy(*unit, "low", "high").applyInArrow(
        run, "node binary, linked long, root binary")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, cell_rows: int = CELL_ROWS,
                    **options) -> DataFrame:
    """Of every row: vec_id, n_links, component_id, kept.

    Vectors are linked when their labels and lengths are equal and the cosine of their doubles
    is at least ``cosine``, which lies above 0. A null label, and a vector that is null, empty
    or zero, or has a null or non-finite component, links with nothing. Rows with equal vectors
    are linked, so repeated rows count each other. A null vec_id is smallest only where a
    component has no other. Scale does not matter; columns besides vec_id, label and embedding
    play no part. An empty table gives an empty result.
    """
    if not 0 < cosine <= 1:
        raise ValueError("the cosine lies above 0 and is at most 1")
    rows, dtype = _read(vectors)
    distinct = landed(rows.where("node IS NOT NULL").groupBy(
        "label", "dim", "vector", "node").agg(F.count("*").alias("copies"),
                                              F.min("vec_id").alias("first_id")), "vectors")
    found = landed(links(distinct, dtype, cosine, cell_rows, **options), "links")
    counts = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    slim = distinct.select("node", "copies", "first_id").join(counts, "node", "left").join(
        roots, "node", "left")
    slim = slim.select("node", "first_id", F.coalesce("root", "node").alias("root"),
                       (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    slim = landed(slim, "classes")
    ids = slim.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = landed(slim.join(ids, "root").select("node", "n_links", "component_id"), "members")
    alone = F.col("node").isNull()
    return rows.select("vec_id", "node").join(classes, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, True).otherwise(F.col("vec_id").eqNullSafe(F.col("component_id"))).alias("kept"))
