"""Quality classifier learnt from trusted positives and unlabelled web text.

Each whole text gets figures of its words, characters and lines (``FIGURES``);
the classifier is additive over their bins. It minimises the non-negative
unbiased risk of positive-unlabelled learning (Kiryo et al. 2017): with the
class prior pi, the risk is pi * R_p(+1) + max(0, R_u(-1) - pi * R_p(-1)), and
where the second part goes below zero the step is taken back against it.
Positives are a bounded sample of the training rows labelled 1, the unlabelled
set is a bounded sample of all documents; labels 0 are never used. The class
prior is estimated from these two sets: a first classifier tells positives from
unlabelled rows, and on rows that it has not seen the prior is the least ratio,
over its scores, of the share of unlabelled rows above a score to that of
positives (best bin estimation, Garg et al. 2021). The margin becomes a
probability by a monotone logistic curve, fitted to the same risk and to the
prior on rows that the classifier has not seen.

Cases: null and empty texts have the figures of an empty text and a score like
any other; null labels and labels other than 0 and 1 are left out; of rows that
share a key the least text is learnt from; without a positive training row every
score is 0. A null key is never held out. Texts are read whole, whatever their
length; of equally frequent words the first counts. Repeated rows are scored
alike; other columns pass through, but one named like the score is replaced;
labels, language, source and key never enter a score.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cellstrata.llm.labelled import labelled, remainder, sampled
from cellstrata.llm.memory import batches_of

THRESHOLD = 0.7
FIGURES = (
    "log_words", "log_chars", "word_length", "word_spread", "short_words", "long_words", "distinct_words", "top_word", "top_pair", "log_lines",
    "line_words", "distinct_lines", "lines_ended", "upper", "digits", "ascii_marks", "commas_stops", "other_marks", "blanks", "wide", "bare_words",
    "marked_words", "capital_words", "sentence_words", "longest_word", "doubled_marks", "repeated_words",
)

_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_BLANK = b" \t\n\r\x0b\x0c"
_STOPS = b".,;:!?'\"()-"
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in _STOPS)
_WIDE = bytes(range(128, 256))


def figures(text: str | None) -> list[float]:
    """The figures of one whole text."""
    b = (text or "").encode()
    n = len(b)
    ws = b.split()
    k = len(ws)
    if not k:
        return [0.0] * len(FIGURES)
    has = lambda cs: n - len(b.translate(None, cs))
    lengths = np.fromiter(map(len, ws), np.int64, k)
    counts = Counter(ws)
    pairs = Counter(zip(ws, ws[1:])) if k > 1 else Counter()
    lines = [x for x in b.split(b"\n") if x.strip()]
    bare = b.translate(None, _STOPS + _MARKS).split()  # words that have more than marks
    stops, marks, upper = has(_STOPS), has(_MARKS), has(_UPPER)
    return [
        math.log1p(k),
        math.log1p(n),
        float(lengths.mean()),
        float(lengths.std()),
        float((lengths <= 3).mean()),
        float((lengths >= 12).mean()),
        len(counts) / k,
        counts.most_common(1)[0][1] / k,
        (pairs.most_common(1)[0][1] / (k - 1)) if pairs else 0.0,
        math.log1p(len(lines)),
        k / len(lines),
        len(set(lines)) / len(lines),
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines),
        upper / n,
        has(_DIGITS) / n,
        (stops + marks) / n,
        has(b".,") / n,
        marks / n,
        has(_BLANK) / n,
        has(_WIDE) / n,
        1 - len(bare) / k,
        sum(w[-1] in _MARKS or w[-1] == 33 for w in ws) / k,
        sum(65 <= w[0] <= 90 for w in ws) / k,
        k / (1 + b.count(b". ") + b.count(b"! ") + b.count(b"? ") + len(lines)),
        math.log1p(int(lengths.max())),
        (b.count(b"!!") + b.count(b"**") + b.count(b"##") + b.count(b"$$") + b.count(b"%%") + b.count(b"&&")) / k,
        sum(map(bytes.__eq__, ws, ws[1:])) / k,
    ]


def _table(df: DataFrame) -> np.ndarray:
    values = df.select("figures").toArrow().column("figures").to_pylist()
    return np.array(values, float).reshape(len(values), len(FIGURES))


class Additive:
    """Figures to bins, and a weight for each bin; ``a``, ``b`` of the curve over the margin."""

    def __init__(self, edges: list[np.ndarray]):
        self.edges = edges
        self.starts = np.concatenate([[0], np.cumsum([len(e) + 1 for e in edges])])[:-1]
        self.w = np.zeros(int(sum(len(e) + 1 for e in edges)) + 1)
        self.a, self.b = 1.0, 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([s + np.searchsorted(e, x[:, j], side="right") for j, (s, e) in enumerate(zip(self.starts, self.edges))])

    def margin(self, bins: np.ndarray) -> np.ndarray:
        return self.w[bins].sum(1) + self.w[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margin(self.bins(x)) + self.b, -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Adam:
    """Steps of Kingma and Ba (2015) on one array."""

    def __init__(self, w: np.ndarray, rate: float):
        self.w, self.rate, self.first, self.second, self.n = w, rate, np.zeros_like(w), np.zeros_like(w), 0

    def step(self, grad: np.ndarray) -> None:
        self.n += 1
        self.first = 0.9 * self.first + 0.1 * grad
        self.second = 0.999 * self.second + 0.001 * grad**2
        self.w -= self.rate * (self.first / (1 - 0.9**self.n)) / (np.sqrt(self.second / (1 - 0.999**self.n)) + 1e-9)


def slopes(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Slope of the non-negative unbiased risk by each margin of the positives and of the unlabelled rows, logistic loss."""
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    of_p, of_u = -prior * _sigmoid(zp) / len(zp), _sigmoid(zu) / len(zu)
    if negative >= 0:
        return of_p + prior * (_sigmoid(zp) - 1) / len(zp), of_u
    return -of_p, -of_u


def binned(positive: np.ndarray, unlabelled: np.ndarray, bins: int) -> tuple[Additive, np.ndarray, np.ndarray]:
    both = np.concatenate([positive, unlabelled])
    model = Additive([np.unique(np.quantile(both[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(both.shape[1])])
    return model, model.bins(positive), model.bins(unlabelled)


def _pull(rows: np.ndarray, slope: np.ndarray, size: int) -> np.ndarray:
    g = np.bincount(rows.ravel(), np.repeat(slope, rows.shape[1]), size)
    g[-1] = slope.sum()
    return g


def learn(positive: np.ndarray, unlabelled: np.ndarray, prior: float, bins: int = 12, steps: int = 600, rate: float = 0.03, decay: float = 1e-3) -> Additive:
    """Minimise the non-negative unbiased risk, by Adam on the whole samples."""
    model, p, u = binned(positive, unlabelled, bins)
    adam = Adam(model.w, rate)
    for _ in range(steps):
        of_p, of_u = slopes(model.margin(p), model.margin(u), prior)
        adam.step(_pull(p, of_p, len(model.w)) + _pull(u, of_u, len(model.w)) + decay * model.w)
    return model


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, bins: int = 12, steps: int = 200, rate: float = 0.03) -> float:
    """Share of positives among the unlabelled rows; every other row trains the classifier, the rest gives the estimate."""
    model, p, u = binned(positive[::2], unlabelled[::2], bins)
    adam = Adam(model.w, rate)
    for _ in range(steps):  # both sets weigh the same
        of_p, of_u = (_sigmoid(model.margin(p)) - 1) / len(p), _sigmoid(model.margin(u)) / len(u)
        adam.step(_pull(p, of_p, len(model.w)) + _pull(u, of_u, len(model.w)) + 1e-3 * model.w)
    p, u = (np.sort(model.margin(model.bins(x[1::2] if len(x) > 1 else x))) for x in (positive, unlabelled))
    at = np.unique(np.concatenate([p, u]))
    of_p, of_u = (1 - np.searchsorted(z, at, "left") / len(z) for z in (p, u))
    doubt = math.sqrt(math.log(40) / 2) * (1 / math.sqrt(len(p)) + 1 / math.sqrt(len(u)))
    some = of_p > 0
    best = np.argmin((of_u[some] + 1.01 * doubt) / of_p[some])
    return float(np.clip(of_u[some][best] / of_p[some][best], 0.01, 0.99))


def curve(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.02) -> tuple[float, float]:
    """Slope (kept above 0) and constant of a logistic curve over margins.

    The slope is that of least non-negative unbiased risk; with the constant,
    the mean over the unlabelled rows is the prior.
    """
    adam = Adam(np.array([1.0, 0.0]), rate)
    for _ in range(steps):
        a, b = adam.w
        of_p, of_u = slopes(a * positive + b, a * unlabelled + b, prior)
        adam.step(np.array([of_p @ positive + of_u @ unlabelled, of_p.sum() + of_u.sum()]) + 1e-4 * (adam.w - np.array([1.0, 0.0])))
        adam.w[0] = max(0.05, adam.w[0])
    a, (low, high) = float(adam.w[0]), (-40.0 - np.abs(adam.w[0] * unlabelled).max(), 40.0 + np.abs(adam.w[0] * unlabelled).max())
    for _ in range(60):
        b = (low + high) / 2
        low, high = (b, high) if _sigmoid(a * unlabelled + b).mean() < prior else (low, b)
    return a, float(b)


def with_figures(df: DataFrame, text: str = "text") -> DataFrame:
    @F.arrow_udf("array<double>")
    def of(batch: pa.Array) -> pa.Array:
        return pa.array((figures(value.as_py()) for value in batch), pa.list_(pa.float64()))

    return df.withColumn("figures", of(F.col(text)))


def fit(documents: DataFrame, labels: DataFrame, text: str = "text", positives: int = 6000, unlabelled: int = 12_000, column: str = "quality") -> Additive | float:
    """Fit on rows labelled 1 whose crc32 remainder by 4 is not 2, and on all documents without labels; 0 without positives.

    ``positives`` and ``unlabelled`` bound the samples (documents without a key
    count among the unlabelled). A third of each is kept for the curve.
    """
    train = labelled(labels, column).where(remainder("doc_id", 4) != 2)
    docs = documents.select("doc_id", F.col(text).alias("t"))
    ids = sampled(train.where("label = 1"), "doc_id", positives).select("doc_id")
    rows = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("t").alias("t"))
    with batches_of(documents.sparkSession):
        x_p = _table(with_figures(rows, "t"))
        x_u = _table(with_figures(sampled(docs, "doc_id", unlabelled, repeats=True), "t"))
    if not len(x_p):
        return 0.0
    order = np.random.default_rng(5)
    x_p, x_u = order.permutation(x_p), order.permutation(x_u)
    prior = class_prior(x_p, x_u)
    of = lambda x: (x[len(x) // 3 :], x[: len(x) // 3] if len(x) >= 3 else x)
    (p, held_p), (u, held_u) = of(x_p), of(x_u)
    model = learn(p, u, prior)
    model.a, model.b = curve(model.margin(model.bins(held_p)), model.margin(model.bins(held_u)), prior)
    return model


def score(documents: DataFrame, model: Additive | float, text: str = "text", into: str = "score") -> DataFrame:
    """``documents`` plus the score of every whole text."""
    if isinstance(model, float):
        return documents.withColumn(into, F.lit(model))

    @F.arrow_udf("double")
    def of(batch: pa.Array) -> pa.Array:
        x = np.array([figures(value.as_py()) for value in batch], float).reshape(len(batch), len(FIGURES))
        return pa.array(model.score(x), pa.float64())

    return documents.withColumn(into, of(F.col(text)))


def op9_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    docs = documents.select("doc_id", "text")
    return score(docs, fit(docs, labels)).select(
        "doc_id",
        F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
