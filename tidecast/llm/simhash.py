"""Near-duplicate documents by SimHash, searched with BK-trees.

A fingerprint has 64 bits; two texts are linked when their fingerprints differ in at most
``radius`` bits, and a component is what links reach. Four blocks of 16 bits cannot all
differ when three bits do, so every link lies inside a shard of fingerprints that agree on
one block. Each shard is searched through a BK-tree of its own, whose children are keyed by
their distance to the parent; a search follows only edges within the radius. A shard that is
larger than one tree is split by further blocks: of its other 48 bits at most three differ
too, so its links agree on one of four blocks of these. What stays larger than a tree after
two such splits is dealt to trees of about ``tree_rows`` own fingerprints each, and the shard's
others are streamed past each of them, so that no link is lost and a task holds one tree.

Only distinct fingerprints are searched: a group of copies is one of them, however large. A
tree returns each fingerprint's smallest partner class, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import (ascii_lower, column_of, key_of, key_struct, landed, only_rows_of,
                                 text_of, texts, word_blocks)

SHINGLE_WORDS = 3
RADIUS = 3
BLOCKS = 4
#: Fingerprints that one tree holds; larger shards get several trees.
TREE_ROWS = 4096
#: How often a large shard is split by further blocks before it gets several trees.
SPLITS = 2
_SEED = 42
_STEP = 8192


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """SimHash of a text: a bit is 1 if it is set in over half the shingle hashes.

    Fewer words than a shingle has: the whole sequence is the one shingle. None: zero.
    """
    ones, total, last = np.zeros(64, dtype=np.int64), 0, []
    for block in word_blocks(text, keep=words - 1):
        last = block
        shingles = zip(*(block[i:] for i in range(words)), strict=False)
        hashes = [xxhash.xxh64_intdigest(b" ".join(s), _SEED) for s in shingles]
        for at in range(0, len(hashes), _STEP):
            some = np.array(hashes[at:at + _STEP], dtype="<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(last), _SEED) if last else 0
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, text_key and fingerprint (its 64 bits as a signed number) of every row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = [fingerprint(t, words) for t in texts(b)]
            bits = pa.array(np.array(found, dtype="<u8").view("<i8"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), bits], ["doc_id", "text_key", "bits"])

    slim = docs.select("doc_id", key_of(text_of()).alias("text_key"),
                       ascii_lower(text_of()).alias("text"))
    return slim.mapInArrow(run, f"doc_id {id_type}, text_key long, bits long")


class BKTree:
    """Children of a node are keyed by their distance to it."""

    def __init__(self):
        self.bits: list[int] = []
        self.kids: list[dict[int, int]] = []

    def add(self, bits: int) -> None:
        self.bits.append(bits)
        self.kids.append({})
        new, node = len(self.bits) - 1, 0
        while node != new:
            edge = (bits ^ self.bits[node]).bit_count()
            node = self.kids[node].setdefault(edge, new)

    def near(self, bits: int, radius: int) -> list[int]:
        """Positions of the members within the radius."""
        found, todo = [], [0] if self.bits else []
        while todo:
            node = todo.pop()
            d = (bits ^ self.bits[node]).bit_count()
            if d <= radius:
                found.append(node)
            kids = self.kids[node]
            if kids:
                todo += [k for edge, k in kids.items() if d - radius <= edge <= d + radius]
        return found


class Shard:
    """A tree's own members and their classes: those within the radius of each other.

    Each member is linked to the smallest member of its class, each other fingerprint to the
    smallest of every class it touches.
    """

    def __init__(self, own: list[int], radius: int):
        self.own, self.radius = sorted(own), radius  # so that a class's first is its smallest
        self.tree, self.up = BKTree(), list(range(len(own)))
        for i, bits in enumerate(self.own):
            for j in self.tree.near(bits, radius):
                a, b = self.top(i), self.top(j)
                if a != b:
                    self.up[max(a, b)] = min(a, b)
            self.tree.add(bits)

    def top(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def links(self) -> Iterator[tuple[int, int]]:
        for i, bits in enumerate(self.own):
            if self.top(i) != i:
                yield bits, self.own[self.top(i)]

    def links_of(self, other: int) -> Iterator[tuple[int, int]]:
        for root in {self.top(j) for j in self.tree.near(other, self.radius)}:
            yield other, self.own[root]


def _search(radius: int) -> Callable:
    def links_in(rows) -> Iterator[tuple[int, int]]:
        """Of rows sorted by shard, a shard's own members first; only those are held."""
        at, own, shard = None, [], None
        for name, x, mine in rows:
            if name != at:
                if shard is None:
                    yield from Shard(own, radius).links()
                at, own, shard = name, [], None
            if mine:
                own.append(x)
                continue
            if shard is None:
                shard = Shard(own, radius)
                yield from shard.links()
            yield from shard.links_of(x)
        if shard is None:
            yield from Shard(own, radius).links()

    def rows_of(batches):
        for b in batches:
            bits = b.column("bits").to_numpy().view("<u8").tolist()
            names = zip(column_of(b, "mask"), column_of(b, "value"), column_of(b, "tree"),
                        strict=True)
            yield from zip(names, bits, column_of(b, "own"), strict=True)

    def run(batches):
        links = links_in(rows_of(batches))
        while some := list(islice(links, _STEP)):
            pairs = np.array(some, dtype="<u8").view("<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])],
                                             ["a", "b"])

    return run


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _narrower(mask: int) -> list[int]:
    """The mask with each of four blocks of the bits it leaves out."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * k // BLOCKS for k in range(BLOCKS + 1)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def shards(prints: DataFrame, tree_rows: int = TREE_ROWS, splits: int = SPLITS) -> DataFrame:
    """Where fingerprints meet: mask, value (of the bits in the mask), tree, own and bits.

    Members of a shard of more than ``tree_rows`` meet again where they agree on one of four
    blocks of their other bits too, so many ``splits`` deep. What is too large even then is
    dealt to several trees: each member is the own one of one of them and is sent past all.
    """
    masks, level, parts = [0], prints.select("bits", F.lit(0).cast("long").alias("mask")), []
    for depth in range(splits + 1):
        below = {m: _narrower(m) for m in masks}
        known = F.create_map(*[c for m, kids in below.items() for c in (
            F.lit(_signed(m)), F.array(*[F.lit(_signed(k)) for k in kids]))])
        masks = list(dict.fromkeys(k for kids in below.values() for k in kids))
        level = level.select("bits", F.explode(known[F.col("mask")]).alias("mask")).select(
            "bits", "mask", F.col("bits").bitwiseAND(F.col("mask")).alias("value"))
        sizes = level.groupBy("mask", "value").agg(F.count("*").alias("n"))
        large = landed(sizes.where(F.col("n") > tree_rows).select(
            "mask", "value", F.ceil(F.col("n") / tree_rows).cast("int").alias("trees")), "shards")
        if large.isEmpty():
            parts.append(level.withColumn("trees", F.lit(1)))
            break
        on = ["mask", "value"]
        if depth == splits:
            parts.append(level.join(large, on, "left").select(
                "bits", *on, F.coalesce("trees", F.lit(1)).alias("trees")))
        else:
            parts.append(level.join(large, on, "left_anti").withColumn("trees", F.lit(1)))
            level = landed(level.join(large, on, "left_semi").select("bits", "mask"), "split")
    members = reduce(DataFrame.unionByName, parts)
    home = F.pmod(F.xxhash64("bits"), F.col("trees")).cast("int")
    trees = members.withColumn("home", home).withColumn(
        "tree", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
    return trees.select("mask", "value", "tree", "bits",
                        (F.col("tree") == F.col("home")).alias("own"))


def near_links(prints: DataFrame, radius: int = RADIUS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all those within the radius."""
    if radius >= BLOCKS:
        raise ValueError(f"{BLOCKS} blocks find at most {BLOCKS - 1} differing bits")
    placed = shards(prints, tree_rows).repartition("mask", "value", "tree").sortWithinPartitions(
        "mask", "value", "tree", F.desc("own"))
    return placed.mapInArrow(_search(radius), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """Of each linked node the smallest reachable one: (node, root).

    Large-star and small-star rounds until nothing changes. Each round is written to the
    shared folder; a node with many neighbours only ever has their minimum taken.
    """
    edges, before = landed(links.where("a <> b").select("a", "b"), "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"),
                                                            F.col("m").alias("b")).distinct()
        large = landed(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"),
                                                              F.col("m").alias("b"))
        edges = landed(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(),
                       "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS,
                    tree_rows: int = TREE_ROWS) -> DataFrame:
    """Of every row: doc_id, text_key, bits, the component's root and its smallest doc_id.

    Null texts count as empty ones, and texts without a word all have fingerprint zero: they
    are linked like any other. A null doc_id is never the smallest unless a component has
    no other. Repeated rows each get a row. Columns besides doc_id and text play no part. The
    root is a fingerprint and, unlike the smallest doc_id, that of one component only.
    """
    prints = landed(fingerprints(docs, words), "fingerprints")
    distinct = landed(prints.groupBy("bits").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(near_links(distinct, radius, tree_rows))
    placed = distinct.join(roots, distinct["bits"] == roots["node"], "left").select(
        "bits", "first_id", F.coalesce("root", "bits").alias("root"))
    ids = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = landed(placed.join(ids, "root").select("bits", "root", "component_id"), "classes")
    return prints.join(classes, "bits")


def one_of_each(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows that stay: of each component the one with its smallest doc_id.

    Among several texts with that id the one with the smallest text_key stays. Components
    are told apart by their roots: several may share an id, or have none.
    """
    found = near_duplicates(docs, words, radius)
    first = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_key")
    keep = found.groupBy("root").agg(F.min(first).alias("first")).select("first.*")
    return only_rows_of(docs, landed(keep.select("doc_id", "text_key"), "kept"))


# --- texts of a stated similarity, told by wide fingerprints and verified ---------------------

SIMILAR_WORDS, SIMILARITY = 5, 0.8
#: 64-bit words of a wide fingerprint, and bits of it that a shard agrees on, so many choices.
PARTS, BANDS, BAND_BITS = 2, 64, 16
#: Free bits of a shard's number below those for what its members agree on.
SUB_BITS = 12
_WIDTH = 64 * PARTS
_SHIFTS = (30, 27, 31)
_MULTIPLIERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _again(hashes: np.ndarray, part: int) -> np.ndarray:
    """Other hashes of the same shingles: theirs, stepped and mixed once more."""
    h = hashes + np.uint64(part * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, by in zip(_SHIFTS, _MULTIPLIERS, strict=False):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(_SHIFTS[2]))


def shingle_hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of a text, in blocks; fewer words are one shingle, none is none."""
    total, last = 0, []
    for block in word_blocks(text, keep=words - 1):
        last = block
        found = [xxhash.xxh64_intdigest(b" ".join(s), _SEED)
                 for s in zip(*(block[i:] for i in range(words)), strict=False)]
        total += len(found)
        for at in range(0, len(found), _STEP):
            yield np.array(found[at:at + _STEP], dtype="<u8")
    if last and not total:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(last), _SEED)], dtype="<u8")


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    return np.unique(np.concatenate([np.zeros(0, "<u8"), *shingle_hashes(text, words)]))


def wide_print(text: bytes, words: int = SIMILAR_WORDS) -> bytes:
    """A SimHash of several words of 64 bits, each from hashes of its own.

    Every shingle counts once, as in the similarity that it stands for.
    """
    found, ones = shingle_set(text, words), np.zeros(_WIDTH, dtype=np.int64)
    for at in range(0, len(found), _STEP):
        wide = np.stack([_again(found[at:at + _STEP], p) for p in range(PARTS)], axis=1).astype("<u8")
        ones += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    if not len(found):
        return bytes(_WIDTH // 8)
    return np.packbits(2 * ones > len(found), bitorder="little").tobytes()


def wide_radius(similarity: float) -> int:
    """Differing bits up to which two texts of this similarity lie, in 97 of 100 cases.

    Sets of equal size with Jaccard similarity j have cosine 2j / (1 + j), and a bit differs
    with the share of their angle in a half turn.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(_WIDTH * p + 2 * math.sqrt(_WIDTH * p * (1 - p)))


def _choices(n: int, size: int, seed: int) -> np.ndarray:
    """So many choices of bit positions, the same everywhere."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(_WIDTH)[:size] for _ in range(n)])


def _values(prints: pa.Array, choices: np.ndarray) -> np.ndarray:
    """The bits at each choice of positions as a number: a row per print."""
    raw = np.frombuffer(b"".join(prints.to_pylist()), dtype=np.uint8).reshape(len(prints), -1)
    bits = np.unpackbits(raw, axis=1, bitorder="little")[:, choices]
    return bits.astype(np.int64) @ (1 << np.arange(choices.shape[1], dtype=np.int64))


def _banded(choices: np.ndarray):
    """Rows of (shard, print, root): the shard's number holds the choice and what it agrees on."""
    def run(batches):
        for b in batches:
            if not len(b):
                continue
            found = _values(b.column("print"), choices)
            name = np.arange(found.shape[1], dtype=np.int64)[None]
            shard = (name << 32) | (found << SUB_BITS)
            at = pa.array(np.repeat(np.arange(len(b)), found.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.ravel()), b.column("print").take(at), b.column("root").take(at)],
                ["shard", "print", "root"])

    return run


class Forest:
    """Pairs of a tree's members within the radius that connect what all such pairs do.

    A shortest spanning forest: whatever distance is too far in the end, the pairs below it
    still connect what all pairs below it connect. Close pairs join at once, the others wait.
    """

    def __init__(self, own: list[int], radius: int):
        self.own, self.radius, self.tree = own, radius, BKTree()
        self.up = list(range(len(own)))
        self.pairs: list[tuple[int, int]] = []
        wait: dict[tuple[int, int], tuple[int, int, int]] = {}
        for i, x in enumerate(own):
            near = sorted(((x ^ own[j]).bit_count(), j) for j in self.tree.near(x, radius))
            for d, j in near:
                a, b = self.top(i), self.top(j)
                if a == b:
                    continue
                if 3 * d <= radius:
                    self._join(i, j)
                else:
                    key = (a, b) if a < b else (b, a)
                    wait[key] = min(wait.get(key, (d, i, j)), (d, i, j))
            self.tree.add(x)
        for _, i, j in sorted(wait.values()):
            if self.top(i) != self.top(j):
                self._join(i, j)

    def _join(self, i: int, j: int) -> None:
        self.pairs.append((self.own[i], self.own[j]))
        self.up[self.top(i)] = self.top(j)

    def top(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i


_GROUP = ["shard", "low", "high"]


def _groups(batches, rows_of: Callable) -> Iterator[tuple[tuple, list]]:
    """Members of one shard, or of two blocks of a large one, under its name; one is held."""
    at, members = None, []
    for b in batches:
        names = zip(*(column_of(b, c) for c in _GROUP), strict=True)
        for name, row in zip(names, rows_of(b), strict=True):
            if name != at:
                if len(members) > 1:
                    yield at, members
                at, members = name, []
            members.append(row)
    if len(members) > 1:
        yield at, members


def _number(wide: bytes) -> int:
    return int.from_bytes(wide, "little")


def _forests(radius: int) -> Callable:
    """Pairs (a, b) of fingerprints of a group that connect all those within the radius."""
    def run(batches):
        groups = _groups(batches, lambda b: map(_number, b.column("print").to_pylist()))
        found = (p for _, members in groups for p in Forest(members, radius).pairs)
        while some := list(islice(found, _STEP)):
            a, b = ([x.to_bytes(_WIDTH // 8, "little") for x in side]
                    for side in zip(*[(min(p), max(p)) for p in some], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())],
                                             ["a", "b"])

    return run


def unlike_members(members: list[tuple[int, bytes]], radius: int, masks: list[int],
                   choice: int) -> set[int]:
    """Positions of those with another root's fingerprint within the radius.

    Two that agree on several choices of bits count in the first of these only.
    """
    tree, found = BKTree(), set()
    if len({root for _, root in members}) > 1:
        for i, (x, root) in enumerate(members):
            for j in tree.near(x, radius):
                if members[j][1] != root and not (i in found and j in found):
                    differ = x ^ members[j][0]
                    if next(k for k, m in enumerate(masks) if not differ & m) == choice:
                        found |= {i, j}
            tree.add(x)
    return found


def _unlike(radius: int) -> Callable:
    masks = [sum(1 << int(k) for k in c) for c in _choices(BANDS, BAND_BITS, 1)]

    def run(batches):
        def rows() -> Iterator[tuple]:
            both = lambda b: zip(b.column("print").to_pylist(), b.column("root").to_pylist(), strict=True)
            for name, members in _groups(batches, both):
                known = [(_number(x), root) for x, root in members]
                for i in sorted(unlike_members(known, radius, masks, name[0] >> 32)):
                    yield *name, *members[i]

        found = rows()
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        while some := list(islice(found, _STEP)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(zip(*some, strict=True), kinds, strict=True)],
                [*_GROUP, "print", "root"])

    return run


def links_between(members: list[tuple[int, bytes, np.ndarray]], radius: int,
                  similarity: float) -> Iterator[tuple[bytes, bytes]]:
    """Pairs of roots that connect what all similar members within the radius connect.

    The shingles that a member shares with each earlier one are counted from lists of the
    members that hold a shingle.
    """
    up: dict[bytes, bytes] = {root: root for _, root, _ in members}

    def top(root: bytes) -> bytes:
        while up[root] != root:
            up[root] = up[up[root]]
            root = up[root]
        return root

    sizes = np.array([len(x) for _, _, x in members])
    codes = np.unique(np.concatenate([x for _, _, x in members]), return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    holders = np.repeat(np.arange(len(members)), sizes)[order]
    ends = np.cumsum(np.bincount(codes)) if len(codes) else codes
    own = np.split(codes, np.cumsum(sizes)[:-1])
    for i, (x, root, _) in enumerate(members):
        lists = [holders[ends[c - 1] if c else 0:ends[c]] for c in own[i].tolist()]
        shared = np.bincount(np.concatenate(lists), minlength=i)[:i] if lists else np.zeros(i)
        like = shared >= similarity * (sizes[i] + sizes[:i] - shared) - 1e-9
        for j in np.flatnonzero(like).tolist():
            a, b = top(root), top(members[j][1])
            if a != b and (x ^ members[j][0]).bit_count() <= radius:
                up[a] = b
                yield root, members[j][1]


def _verified(radius: int, similarity: float) -> Callable:
    def rows_of(b):
        ends, values = b.column("shingles").offsets.to_numpy(), b.column("shingles").values.to_numpy()
        sets = (values[i:j].copy() for i, j in zip(ends, ends[1:], strict=False))
        prints = map(_number, b.column("print").to_pylist())
        return zip(prints, b.column("root").to_pylist(), sets, strict=True)

    def run(batches):
        groups = _groups(batches, rows_of)
        found = (p for _, members in groups for p in links_between(members, radius, similarity))
        while some := list(islice(found, _STEP)):
            a, b = zip(*[(min(p), max(p)) for p in some], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())],
                                             ["a", "b"])

    return run


def _in_shards(prints: DataFrame) -> DataFrame:
    return prints.select("print", "root").mapInArrow(
        _banded(_choices(BANDS, BAND_BITS, 1)), "shard long, print binary, root binary")


def large_shards(prints: DataFrame, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Shards of more members than a tree holds, and into how many blocks they are dealt."""
    sizes = _in_shards(prints).groupBy("shard").agg(F.count("*").alias("n"))
    return sizes.where(F.col("n") > tree_rows).select(
        "shard", F.ceil(2 * F.col("n") / tree_rows).cast("int").alias("blocks"))


def meetings(prints: DataFrame, large: DataFrame) -> DataFrame:
    """Fingerprints (print, root) by the groups in which they meet: shard, and blocks low and high.

    Any two blocks of a large shard meet, so all its members do, as those of a small one; a
    tree holds two blocks at most.
    """
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = _in_shards(prints).join(large, "shard", "left").withColumn("blocks", blocks).withColumn(
        "home", F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1),
                      lambda j: (j != F.col("home")) | (F.col("blocks") == 1))
    dealt = dealt.withColumn("other", F.explode(others)).select(
        "shard", F.least("home", "other").alias("low"), F.greatest("home", "other").alias("high"),
        "print", "root")
    return dealt.repartition(*_GROUP).sortWithinPartitions(*_GROUP)


def candidate_pairs(prints: DataFrame, large: DataFrame, radius: int) -> DataFrame:
    """(a, b): distinct fingerprints near each other, as many as connect all such of a group."""
    return meetings(prints, large).mapInArrow(_forests(radius), "a binary, b binary").distinct()


def shingle_sets(docs: DataFrame, firsts: DataFrame, named: DataFrame, words: int) -> DataFrame:
    """(print, shingles) of the prints named.

    ``firsts`` names a document (doc_id, text_key) of each fingerprint, whose text is read.
    Shingles are told apart by 64-bit hashes.
    """
    def run(batches):
        for b in batches:
            sets = [shingle_set(t, words).view("<i8") for t in texts(b)]
            yield pa.RecordBatch.from_arrays(
                [b.column("print"), pa.array(sets, pa.list_(pa.int64()))], ["print", "shingles"])

    named = firsts.join(named.select("print").distinct(), "print", "left_semi").select(
        "print", key_struct("doc_id", "text_key"))
    keyed = docs.select("doc_id", key_of(text_of()).alias("text_key"), ascii_lower(text_of()).alias("text"))
    texts_of = keyed.select(key_struct("doc_id", "text_key"), "text").join(named, "key").groupBy(
        "print").agg(F.first("text").alias("text"))
    return landed(texts_of.mapInArrow(run, "print binary, shingles array<long>"), "shingles")


def similar_links(docs: DataFrame, firsts: DataFrame, pairs: DataFrame, words: int,
                  similarity: float) -> DataFrame:
    """The pairs whose texts have the similarity, by their sets of shingles."""
    named = pairs.select(F.col("a").alias("print")).union(pairs.select("b"))
    sets = shingle_sets(docs, firsts, named, words)
    both = pairs.join(sets.select(F.col("print").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("print").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared) - 1e-9).select(
        "a", "b")


def links_left(docs: DataFrame, firsts: DataFrame, placed: DataFrame, large: DataFrame, radius: int,
               words: int, similarity: float) -> DataFrame:
    """Links (a, b) between roots of fingerprints (print, root) that similar pairs still connect.

    Members with a partner of another root come together again, now with their shingles, and
    are verified in their group. Rows are members and links, never pairs.
    """
    fields = "shard long, low int, high int, print binary, root binary"
    left = landed(meetings(placed, large).mapInArrow(_unlike(radius), fields), "unlike")
    held = left.join(shingle_sets(docs, firsts, left, words), "print")
    held = held.repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    return held.mapInArrow(_verified(radius, similarity), "a binary, b binary").distinct()


def similar_documents(docs: DataFrame, words: int = SIMILAR_WORDS, similarity: float = SIMILARITY,
                      tree_rows: int = TREE_ROWS) -> DataFrame:
    """Of every row: doc_id, text_key, print and the root of its component.

    Texts are linked when the Jaccard similarity of their shingle sets is at least
    ``similarity``: wide fingerprints within ``wide_radius`` that agree on one of many choices
    of bits meet in a BK-tree. What connects them there is verified on the texts first, then
    every such pair that this has not brought into one component; so components are those of
    all pairs that meet, however these are dealt to trees. Which pairs meet depends on the two
    texts alone. The search is not whole; its recall on the given tables is stated in the
    README. Nulls, empty and repeated rows are as in ``near_duplicates``; texts of one
    fingerprint are linked.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = pa.array([wide_print(t, words) for t in texts(b)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), found], ["doc_id", "text_key", "print"])

    slim = docs.select("doc_id", key_of(text_of()).alias("text_key"),
                       ascii_lower(text_of()).alias("text"))
    prints = landed(slim.mapInArrow(run, f"doc_id {id_type}, text_key long, print binary"), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_key"))
    firsts = landed(prints.groupBy("print").agg(first.alias("first")).select("print", "first.*"), "firsts")
    radius, alone = wide_radius(similarity), firsts.select("print", F.col("print").alias("root"))
    large = landed(large_shards(alone, tree_rows), "large")

    pairs = landed(candidate_pairs(alone, large, radius), "pairs")

    def joined(placed: DataFrame, links: DataFrame) -> DataFrame:
        of = components(links).select(F.col("node").alias("root"), F.col("root").alias("of"))
        return placed.join(of, "root", "left").select("print", F.coalesce("of", "root").alias("root"))

    placed = landed(joined(alone, similar_links(docs, firsts, pairs, words, similarity)), "placed")
    links = links_left(docs, firsts, placed, large, radius, words, similarity)
    return prints.join(joined(placed, links), "print").select("doc_id", "text_key", "print", "root")


def one_of_similar(docs: DataFrame, words: int = SIMILAR_WORDS, similarity: float = SIMILARITY,
                   tree_rows: int = TREE_ROWS) -> DataFrame:
    """The rows that stay: of each component of similar texts the one with its smallest doc_id."""
    found = similar_documents(docs, words, similarity, tree_rows)
    first = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_key")
    keep = found.groupBy("root").agg(F.min(first).alias("first")).select("first.*")
    return only_rows_of(docs, landed(keep.select("doc_id", "text_key"), "kept"))
