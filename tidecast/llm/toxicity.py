"""Toxicity by a counterfactual-regularised classifier.

A text is the set of its words; a word's features are the word and its beginnings, hashed.
The model is logistic regression. In labelled sentences that name a group of people the name
is swapped for others of its kind, and the squared change of the score is part of the loss:
what the model learns about a group's name from its company is taken back, so that a neutral
mention is not held against a text. An L1 penalty leaves few features with a weight, which
keeps long clean texts from adding up small ones.

Fitting sees a bounded sample of labelled rows, whose features are made on the executors.
Scoring is one pass over whole texts, without a shuffle.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidecast.llm.common import column, texts
from tidecast.llm.labelled import class_weights, fold, sample

FOLDS, HELD_OUT = 3, 1
TOXIC_AT = 0.7
#: Bound of the fit: labelled documents of each class, each with all its features.
PER_CLASS = 2000
BUCKETS = 1 << 20
PREFIXES = (4, 5, 6, 7)
#: Names of groups of people; within a row each may stand for each other.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girl", "boy"), ("girls", "boys"),
    ("female", "male"), ("lesbian", "gay", "bisexual", "straight", "heterosexual", "homosexual"),
    ("transgender", "cisgender", "trans", "nonbinary"),
    ("muslim", "jewish", "christian", "hindu", "buddhist", "sikh", "atheist", "catholic"),
    ("muslims", "jews", "christians", "hindus", "buddhists", "sikhs", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "arab"),
    ("mexican", "american", "chinese", "indian", "german", "french", "russian", "turkish"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "deaf", "blind", "autistic"), ("old", "young", "elderly"),
    ("frauen", "männer"), ("muslime", "juden", "christen"), ("femmes", "hommes"),
    ("musulmans", "juifs", "chrétiens"), ("mujeres", "hombres"),
    ("musulmanes", "judíos", "cristianos"),
)
_LETTERS = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def words_of(text: bytes) -> list[str]:
    return _LETTERS.findall(text.decode("utf-8", "replace").lower())


def word_features(word: str, buckets: int = BUCKETS) -> list[int]:
    parts = [f"{word}$", *(word[:n] for n in PREFIXES if len(word) >= n)]
    return [zlib.crc32(p.encode()) % buckets for p in parts]


def text_features(text: bytes, buckets: int = BUCKETS) -> Counter:
    """How many distinct words have each feature."""
    return Counter(f for w in set(words_of(text)) for f in word_features(w, buckets))


def swaps_of(text: bytes, terms=IDENTITY_TERMS, buckets: int = BUCKETS) -> list[tuple[list, list]]:
    """What changes when a sentence that names a group names another: features, differences.

    Each sentence is made once for each other term of the row that a term of it is in. The
    differences are those of log1p of the number of words, as the fit counts them.
    """
    rows = {t: row for row in terms for t in row}
    found = []
    for sentence in _SENTENCE.split(text.decode("utf-8", "replace").lower()):
        words = set(_LETTERS.findall(sentence))
        named = [w for w in sorted(words) if w in rows]
        if not named:
            continue
        before = Counter(f for w in words for f in word_features(w, buckets))
        for a in named:
            for b in rows[a]:
                if b == a:
                    continue
                after = Counter(f for w in words - {a} | {b} for f in word_features(w, buckets))
                change = {f: math.log1p(after[f]) - math.log1p(before[f]) for f in before | after}
                change = {f: v for f, v in change.items() if v}
                if change:
                    found.append((list(change), list(change.values())))
    return found


@dataclass(frozen=True)
class Model:
    """Weights of the few features that have one."""

    weights: dict[int, float]
    bias: float
    buckets: int = BUCKETS

    def weighted(self, word: str) -> list[int]:
        """Features of the word that have a weight."""
        return [f for f in word_features(word, self.buckets) if f in self.weights]

    def logit(self, text: bytes, weighted: Callable[[str], list[int]] | None = None) -> float:
        """As in the fit, a feature counts with log1p of the number of words that have it."""
        counts = Counter(chain.from_iterable(map(weighted or self.weighted, set(words_of(text)))))
        return math.fsum([self.bias, *(self.weights[f] * math.log1p(n) for f, n in counts.items())])

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -50, 50))))


def fit_rows(rows, y, weight, swaps=(), l1: float = 1e-5, fairness: float = 10.0,
             steps: int = 600, features: int = 2000, buckets: int = BUCKETS) -> Model:
    """Proximal gradient descent with momentum.

    ``rows`` holds (features, counts) of each text, ``swaps`` (features, differences) of each
    swapped sentence; ``fairness`` times the mean squared change of the score is added to the
    loss. Only the features that tell the classes apart best get a weight, none
    of fewer than three texts.
    """
    y, weight = np.asarray(y, float), np.asarray(weight, float)
    if len(rows) == 0:
        return Model({}, 0.0, buckets)
    at = np.repeat(np.arange(len(rows), dtype=np.int32), [len(f) for f, _ in rows])
    raw = np.concatenate([np.asarray(f, np.int32) for f, _ in rows])
    often = np.bincount(raw, minlength=buckets)
    chance = often * y.mean() * (1 - y.mean())
    telling = np.abs(np.bincount(raw, y[at], buckets) - often * y.mean())
    telling /= np.sqrt(np.maximum(chance, 1e-9))
    telling[often < min(3, len(rows))] = -1.0
    kept = np.sort(np.argsort(-telling, kind="stable")[:features])
    kept = kept[telling[kept] >= 0]
    new = np.full(buckets, -1, np.int32)
    new[kept] = np.arange(len(kept))
    col = new[raw]
    use = col >= 0
    at, col = at[use], col[use]
    value = np.log1p(np.concatenate([np.asarray(c, np.int32) for _, c in rows])[use])
    pair, pair_col, pair_value = _columns(swaps, new)
    share = 2 * fairness / max(len(swaps), 1)
    n = len(kept)
    w, b = np.zeros(n), float(np.log((weight * y).sum() + 1e-6) - np.log((weight * (1 - y)).sum()
                                                                         + 1e-6))
    ahead_w, ahead_b, momentum = w, b, 1.0
    norm = np.bincount(at, value ** 2, len(rows)).max(initial=1.0) + 1.0
    curve = 0.25 * (weight * (np.bincount(at, value ** 2, len(rows)) + 1)).sum()
    curve += share * (pair_value ** 2).sum()
    rate = 1.0 / max(curve, 0.25 * norm * weight.max(initial=0.0), 1e-9)
    for _ in range(steps):
        z = np.bincount(at, value * ahead_w[col], len(rows)) + ahead_b
        error = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        grad = np.bincount(col, value * error[at], n)
        change = np.bincount(pair, pair_value * ahead_w[pair_col], len(swaps))
        grad += share * np.bincount(pair_col, pair_value * change[pair], n)
        new_w = ahead_w - rate * grad
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - rate * l1, 0.0)
        new_b = ahead_b - rate * error.sum()
        faster = (1 + (1 + 4 * momentum ** 2) ** 0.5) / 2
        ahead_w = new_w + (momentum - 1) / faster * (new_w - w)
        ahead_b = new_b + (momentum - 1) / faster * (new_b - b)
        w, b, momentum = new_w, new_b, faster
    return Model({int(kept[i]): float(w[i]) for i in np.flatnonzero(w)}, float(b), buckets)


def _columns(swaps, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Swap, column and value of every difference in a feature that has a column."""
    if not len(swaps):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    pair = np.repeat(np.arange(len(swaps)), [len(f) for f, _ in swaps])
    col = place[np.concatenate([np.asarray(f, np.int64) for f, _ in swaps])]
    value = np.concatenate([np.asarray(v, float) for _, v in swaps])
    return pair[col >= 0], col[col >= 0], value[col >= 0]


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, folds: int = FOLDS,
          held_out: int = HELD_OUT, terms=IDENTITY_TERMS, **options) -> Model:
    """A model from a bounded sample of labelled rows outside the held-out fold.

    ``terms`` are rows of names that may stand for each other. Their sentences are swapped on
    the executors; what comes back of one is the features that differ.
    """
    rows, sizes = sample(docs, labels, "toxic", folds, held_out, per_class)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            found, counts, swapped, changes = [], [], [], []
            for t in texts(b):
                f = text_features(t)
                found.append(list(f))
                counts.append(list(f.values()))
                made = swaps_of(t, terms)
                swapped.append([x for x, _ in made])
                changes.append([v for _, v in made])
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("y"), pa.array(found, lists), pa.array(counts, lists),
                 pa.array(swapped, pa.list_(lists)),
                 pa.array(changes, pa.list_(pa.list_(pa.float64())))],
                ["y", "features", "counts", "swapped", "changes"])

    got = rows.select("doc_id", "y", "text").mapInArrow(
        lambda batches: _with_ids(run, batches),
        f"doc_id {kind}, y int, features array<int>, counts array<int>, "
        "swapped array<array<int>>, changes array<array<double>>").toArrow().sort_by("doc_id")
    swaps = [(f, v) for fs, vs in zip(got["swapped"].to_pylist(), got["changes"].to_pylist(), strict=True)
             for f, v in zip(fs, vs, strict=True)]
    y = got["y"].to_numpy()
    pairs = [(f.values.to_numpy(), c.values.to_numpy())
             for f, c in zip(got["features"], got["counts"], strict=True)]
    return fit_rows(pairs, y, class_weights(y, sizes), swaps, **options)


def _with_ids(run, batches):
    for b in batches:
        for made in run(iter([b])):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *made.columns],
                                             ["doc_id", *made.schema.names])


def scores(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """The columns to carry, as c0, c1 and so on whatever their names are, and ``score``."""
    fields = docs.select(*map(column, carry)).schema.fields
    names = [f"c{i}" for i in range(len(carry))]
    read = [column(n).alias(c) for n, c in zip(carry, names, strict=True)]
    where = names[carry.index("text")] if "text" in carry else "text"
    read += [] if "text" in carry else [F.col("text")]

    def run(batches):
        known: dict[str, list[int]] = {}

        def weighted(w: str) -> list[int]:
            found = known.get(w)
            if found is None:
                if len(known) > 200_000:
                    known.clear()
                found = known[w] = model.weighted(w)
            return found

        for b in batches:
            z = np.array([model.logit(t, weighted) for t in texts(b, where)])
            score = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), pa.array(score, pa.float64())], [*names, "score"])

    schema = StructType([StructField(c, f.dataType) for c, f in zip(names, fields, strict=True)])
    return docs.select(*read).mapInArrow(run, schema.add("score", DoubleType()))


def judge(docs: DataFrame, labels: DataFrame, toxic_at: float = TOXIC_AT, model: Model | None = None,
          **options) -> DataFrame:
    """Of every row: doc_id, held_out, score, predicted.

    Null and empty texts have no words and get the score of the intercept, the base rate of
    what has none. Without a usable label every score is one half. Repeated rows get a row
    each; a null id is in no fold; columns besides doc_id and text are never read.
    """
    model = model or train(docs, labels, **options)
    found = scores(docs, model, ["doc_id"]).withColumnRenamed("c0", "doc_id")
    return found.select("doc_id", (fold(FOLDS) == HELD_OUT).alias("held_out"), "score",
                        (F.col("score") >= toxic_at).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, toxic_at: float = TOXIC_AT,
                    model: Model | None = None, **options) -> DataFrame:
    """The rows scored below the threshold, all their columns as they were, in one pass."""
    model = model or train(docs, labels, **options)
    found = scores(docs, model, docs.columns).where(F.col("score") < toxic_at)
    return found.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns)])
