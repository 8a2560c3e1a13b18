"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its features are shares of kinds of characters, repetition and
lengths, of the line itself and of the lines before and after it. Forward and backward sums
give each line's probability of being good; a document's evidence is their mean, weighted by
the lines' lengths, and a logistic curve fitted on labelled documents turns it into a score.

The field is fitted on a bounded sample of labelled rows: every line of a labelled document
carries the document's label. Scoring is one pass over whole texts, without a shuffle. Lines
are cut into chains per document; a batch of documents goes through the sums together.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import texts
from tidecast.llm.labelled import class_weights, fold, sample

FOLDS, HELD_OUT = 5, 0
GOOD_AT = 0.3
#: Bound of the fit: labelled documents of each class, each with all its lines.
PER_CLASS = 2000
EMPTY_SCORE = 0.0

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_HIGH = bytes(range(128, 256))
_MARKS = b"#$%&*@^~=+<>{}[]\\_`/"
_FEATURES = 15


def line_features(line: bytes, words: list[bytes]) -> tuple[float, ...]:
    n, k = len(line), len(words)
    rest = line.translate(None, _LOWER)
    lower = n - len(rest)
    more = rest.translate(None, _HIGH)
    high = len(rest) - len(more)
    rest = more.translate(None, _UPPER)
    upper = len(more) - len(rest)
    digits = sum(map(rest.count, (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9")))
    marks = len(rest) - len(rest.translate(None, _MARKS))
    shown = sum(map(len, words))
    return (
        1.0, lower / n, high / n, upper / (upper + lower + 1), digits / n, 4 * marks / n,
        4 * rest.count(b"|") / n, 4 * rest.count(b"!") / n,
        (rest.count(b".") + rest.count(b",")) / k, shown / k / 10, len(set(words)) / k,
        sum(map(eq, words, words[1:])) / k, np.log1p(k) / 5, float(k < 4),
        float(line[-1:] in b".?"),
    )


def lines_of(text: bytes) -> tuple[list[tuple[float, ...]], list[int]]:
    """Features and lengths of the lines that have a word."""
    rows, sizes = [], []
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            rows.append(line_features(line, words))
            sizes.append(len(line))
    return rows, sizes


def with_neighbours(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Features of the line, the one before and the one after; zeros beyond the ends."""
    n = len(rows)
    first = np.zeros(n, bool)
    last = np.zeros(n, bool)
    ends = np.cumsum(lengths)
    first[(ends - lengths)[lengths > 0]] = True
    last[(ends - 1)[lengths > 0]] = True
    before, after = np.zeros_like(rows), np.zeros_like(rows)
    before[1:], after[:-1] = rows[:-1], rows[1:]
    before[first], after[last] = 0.0, 0.0
    return np.hstack([rows, before, after])


def marginals(z: np.ndarray, lengths: np.ndarray, stay: float) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and P(it is as the line before); z is the line's log odds.

    Chains lie one after the other in ``z``. They are stepped through side by side, longest
    first, so that a step works on all chains that are long enough.
    """
    n = len(z)
    good, same = np.zeros(n), np.zeros(n)
    order = np.argsort(-lengths, kind="stable")
    start, size = (np.cumsum(lengths) - lengths)[order], lengths[order]
    most = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(most), side="left")  # chains longer than t
    ahead, back = np.zeros(n), np.zeros(n)  # log odds of good from the left, from the right
    for t in range(most):
        at = start[:live[t]] + t
        ahead[at] = z[at] + (_passed(ahead[at - 1], stay) if t else 0.0)
    for t in range(most - 1, -1, -1):
        at = start[:live[t]] + t
        more = size[:live[t]] > t + 1
        nxt = at[more] + 1
        back[at[more]] = _passed(z[nxt] + back[nxt], stay)
    good = 1 / (1 + np.exp(-np.clip(ahead + back, -40, 40)))
    inner = np.ones(n, bool)
    inner[start[size > 0]] = False
    i = np.flatnonzero(inner)
    left, right = ahead[i - 1], z[i] + back[i]
    both = np.logaddexp(0.0, left + right) + stay
    same[i] = 1 / (1 + np.exp(np.clip(np.logaddexp(left, right) - both, -40, 40)))
    return good, same


def _passed(odds: np.ndarray, stay: float) -> np.ndarray:
    """Log odds at the next line, of a chain that keeps its label with weight e^stay."""
    return np.logaddexp(odds + stay, 0.0) - np.logaddexp(odds, stay)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    stay: float
    slope: float
    offset: float

    def evidence(self, rows, sizes, lengths) -> np.ndarray:
        """Length-weighted mean of P(good) of each document; nan for one without lines."""
        lengths = np.asarray(lengths, np.int64)
        if not len(rows):
            return np.full(len(lengths), np.nan)
        x = with_neighbours(np.asarray(rows, float), lengths)
        good, _ = marginals(x @ self.weights, lengths, self.stay)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        sizes = np.asarray(sizes, float)
        with np.errstate(invalid="ignore"):
            return np.bincount(doc, sizes * good, len(lengths)) / np.bincount(
                doc, sizes, len(lengths))

    def score(self, evidence: np.ndarray) -> np.ndarray:
        p = np.clip(evidence, 1e-4, 1 - 1e-4)
        z = self.slope * np.log(p / (1 - p)) + self.offset
        return np.where(np.isnan(p), EMPTY_SCORE, 1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _logistic_curve(design: np.ndarray, target: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Slope and offset of the logistic curve, held near (1, 0) where the classes are apart.

    Newton steps on two parameters; one that would make the fit worse is halved until it does
    not, since with classes far apart whole steps run away.
    """
    start = np.array([1.0, 0.0])

    def loss(c: np.ndarray) -> float:
        z = design @ c
        return float((w * (np.logaddexp(0.0, z) - target * z)).sum() + 5e-4 * ((c - start) ** 2).sum())

    curve, now = start, loss(start)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(design @ curve, -40, 40)))
        grad = design.T @ (w * (q - target)) + 1e-3 * (curve - start)
        bend = (design * (w * q * (1 - q))[:, None]).T @ design + 1e-3 * np.eye(2)
        step, found = np.linalg.solve(bend, grad), now
        for _ in range(40):
            found = loss(curve - step)
            if found <= now:
                break
            step = step / 2
        if not found < now:
            break
        curve, now = curve - step, found
    return curve


def fit_rows(rows, sizes, lengths, y, weight, l2: float = 1e-3, steps: int = 250,
             rate: float = 0.1) -> Model:
    """Maximum conditional likelihood by Adam, then the logistic curve of the documents."""
    lengths, y = np.asarray(lengths, np.int64), np.asarray(y)
    if not len(rows) or len(set(y.tolist())) < 2:
        return Model(np.zeros(3 * _FEATURES), 0.0, 1.0, 0.0)
    x = with_neighbours(np.asarray(rows, float), lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    label, share = y[doc].astype(float), np.asarray(weight)[doc] / lengths[doc]
    inner = np.ones(len(x), bool)
    inner[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
    theta = np.zeros(x.shape[1] + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        good, same = marginals(x @ theta[:-1], lengths, theta[-1])
        grad = np.append(x.T @ (share * (good - label)), (share * inner * (same - 1.0)).sum())
        grad += l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        theta -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    model = Model(theta[:-1], float(theta[-1]), 1.0, 0.0)
    found = model.evidence(rows, sizes, lengths)
    has = ~np.isnan(found)
    p = np.clip(found[has], 1e-4, 1 - 1e-4)
    design = np.column_stack([np.log(p / (1 - p)), np.ones(has.sum())])
    curve = _logistic_curve(design, y[has].astype(float), np.asarray(weight)[has])
    return Model(theta[:-1], float(theta[-1]), float(curve[0]), float(curve[1]))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model from a bounded sample of labelled rows outside the held-out fold."""
    picked, sizes = sample(docs, labels, "quality", FOLDS, HELD_OUT, per_class)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows, lengths = [], []
            for t in texts(b):
                x, n = lines_of(t)
                rows.append(np.asarray(x, np.float32).ravel())
                lengths.append(n)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("y"), pa.array(rows, pa.list_(pa.float32())),
                 pa.array(lengths, pa.list_(pa.int32()))], ["doc_id", "y", "rows", "sizes"])

    got = picked.select("doc_id", "y", "text").mapInArrow(
        run, f"doc_id {kind}, y int, rows array<float>, sizes array<int>").toArrow()
    got = got.sort_by("doc_id")
    y = got["y"].to_numpy()
    rows = np.concatenate([np.zeros(0), *(r.values.to_numpy() for r in got["rows"])])
    chars = [n.values.to_numpy() for n in got["sizes"]]
    return fit_rows(rows.reshape(-1, _FEATURES), np.concatenate([np.zeros(0), *chars]),
                    [len(n) for n in chars], y, class_weights(y, sizes))


def judge(docs: DataFrame, labels: DataFrame, good_at: float = GOOD_AT, model: Model | None = None,
          **options) -> DataFrame:
    """Of every row: doc_id, held_out, score, predicted.

    A null text, or one without a word, has no line and scores ``EMPTY_SCORE``. Without
    labels of both classes every other score is one half. A line is never cut, however
    long. Repeated rows get a row each; a null id is in no fold; columns besides doc_id and
    text are never read.
    """
    model = model or train(docs, labels, **options)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows, sizes, lengths = [], [], []
            for t in texts(b):
                x, n = lines_of(t)
                rows += x
                sizes += n
                lengths.append(len(n))
            score = model.score(model.evidence(rows, sizes, lengths))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score)],
                                             ["doc_id", "score"])

    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return found.select("doc_id", (fold(FOLDS) == HELD_OUT).alias("held_out"), "score",
                        (F.col("score") >= good_at).cast("int").alias("predicted"))
