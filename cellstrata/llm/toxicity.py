"""Toxicity from two class-conditional Kneser-Ney bigram models.

Of the labelled training rows a bounded sample, as many toxic as ordinary, gives
the n-gram counts of each class: a word pair counts once for each document that
holds it, a word once for each of its left contexts. Each class model discounts
its bigrams, backs off to its continuation counts, and these to counts shared by
both classes, which cover every word of every document of the corpus; so an
expression that is rare in the sample is smoothed by how common it is at large.
The discounts are those of the counts themselves, n1 / (n1 + 2 n2). What either
class holds gets ``PRIOR`` in both after the discount, so that one document says
little about the classes, a few say more, and none is cut to nothing. Every word
and pair of the sampled rows is in the model, whose size the number of rows
bounds; a word outside it counts alike in both.

A text is compared as a whole and passage by passage: the length-normalised
difference of the two log-likelihoods, over all its words and over windows of
each of ``SPANS`` words, of which the highest two count. A logistic curve over
these figures, fitted on other training rows, turns them into the score.

Cases: null and empty texts, and texts without known words, have differences of
0 and get the score of that point; nulls among labels, and labels other than 0
and 1, are left out; of rows that share a key the least text is learnt from;
without labelled rows of both classes every score is 0, without rows of both for
the curve it is fitted on those of the counts. A null key is never held out.
Texts are read whole, whatever their length; of equal passages the first counts.
Repeated rows are scored alike; other columns pass through, but one named like
the score is replaced; labels, language, source and key never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cellstrata.llm.labelled import labelled, remainder, sampled
from cellstrata.llm.memory import tidy
from cellstrata.llm.words import word_hashes
from cellstrata.plans.lineage import written

SPANS = (1, 4, 16)
PRIOR = 1.0  # documents that each class is given for every word pair that either class holds, at equal rates
TRUST = 50.0  # occurrences of a context that weigh as much as what it backs off to
_START = 1  # the word before the first of a line


# ---- counts -------------------------------------------------------------


def bigram_counts(documents: DataFrame) -> DataFrame:
    """``(h, w, c0, c1)``: how many documents ``(label, t)`` of either class hold a word pair, a line's first word after the start."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = [w for w in map(word_hashes, (text or "").split("\n")) if len(w)]
                if lines:
                    w = np.concatenate(lines)
                    h = np.concatenate([[_START], w[:-1]])
                    h[np.cumsum([0] + [len(x) for x in lines[:-1]])] = _START
                    pairs = np.unique(np.stack([h, w]), axis=1)
                    parts.append(np.concatenate([pairs, np.full((1, pairs.shape[1]), label)]))
            if parts:
                h, w, c = np.concatenate(parts, axis=1)
                order = np.lexsort((w, h))
                h, w, c = h[order], w[order], c[order]
                first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])]))
                c0, c1 = np.add.reduceat(1 - c, first), np.add.reduceat(c, first)
                yield pa.RecordBatch.from_pydict({"h": h[first], "w": w[first], "c0": c0, "c1": c1})

    pairs = documents.select("label", "t").mapInArrow(count, "h long, w long, c0 long, c1 long")
    return pairs.groupBy("h", "w").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def discounts(df: DataFrame, counts: str) -> list[float]:
    """The Kneser-Ney discount n1 / (n1 + 2 n2) of the counts of each class."""
    few = df.agg(*[F.count(F.when(F.col(f"{counts}{c}") == n, 1)).alias(f"n{n}{c}") for c in (0, 1) for n in (1, 2)]).first()
    return [few[f"n1{c}"] / (few[f"n1{c}"] + 2 * few[f"n2{c}"]) if few[f"n1{c}"] and few[f"n2{c}"] else 0.5 for c in (0, 1)]


def shared_counts(documents: DataFrame, text: str, known: np.ndarray) -> np.ndarray:
    """Occurrences of each known word in all documents; the last entry is the number of all words."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            for value in batch.column(0):
                w = word_hashes(value.as_py() or "")
                at = np.minimum(np.searchsorted(known, w), len(known) - 1)
                np.add.at(seen, at[known[at] == w], 1)
                seen[-1] += len(w)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"i": some.astype(np.int64), "n": seen[some]})

    rows = documents.select(text).mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(known) + 1, np.int64)
    out[rows.column("i").to_numpy()] = rows.column("n").to_numpy()
    return out


# ---- the models ---------------------------------------------------------


class Models:
    """Both class models over the known words; ``ratio`` gives each word's log-likelihood difference."""

    def __init__(self, words, continuations, totals, shared, contexts, pairs, types, discount, prior):
        self.words = words
        size = len(words)
        p_shared = (shared[:-1] + 1.0) / (shared[-1] + size + 1.0)
        self.low, self.weight, self.high = [], [], []
        context = pairs[0] // size if size else pairs[0]
        for c in (0, 1):
            kept = (np.maximum(continuations[c] - discount[0][c], 0) + prior[0][c]) / max(1, totals[c] + prior[0][c] * types[0])
            self.low.append((kept + (1 - kept.sum()) * p_shared).astype(np.float32))
            count = contexts[c] + prior[1][c] * types[1] + TRUST  # of each known word as a context, and of the start
            high = (np.maximum(pairs[1 + c] - discount[1][c], 0) + prior[1][c]) / count[context]
            self.weight.append((1 - np.bincount(context, high, size + 1)).astype(np.float32))
            self.high.append(high.astype(np.float32))
        self.keys = pairs[0]

    def ratio(self, w: np.ndarray) -> np.ndarray:
        words, size = self.words, len(self.words)
        at = np.minimum(np.searchsorted(words, w), size - 1)
        known = words[at] == w
        h = np.concatenate([[size], np.where(known, at, -1)[:-1]])
        out = np.zeros(len(w))
        i, h = at[known], h[known]
        p = []
        if len(self.keys):
            key = h * size + i
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = (self.keys[k] == key) & (h >= 0)
        for c in (0, 1):
            weight = np.where(h >= 0, self.weight[c][h], 1.0)
            high = np.where(there, self.high[c][k], 0.0) if len(self.keys) else 0.0
            p.append(high + weight * self.low[c][i])
        out[known] = np.log(p[1]) - np.log(p[0])
        return out

    def figures(self, text: str | None) -> list[float]:
        """Differences by length: of the whole text; for each span, of the highest passage and the next that does not overlap it."""
        out = [0.0] * (1 + 2 * len(SPANS))
        r = self.ratio(word_hashes(text)) if text else np.zeros(0)
        if not len(r):
            return out
        run = np.concatenate([[0.0], np.cumsum(r)])
        out[0] = float(r.mean())
        for i, span in enumerate(SPANS):
            if len(r) <= span:
                out[1 + 2 * i] = float(run[-1] / span)
                continue
            passages = (run[span:] - run[:-span]) / span
            top = int(passages.argmax())
            out[1 + 2 * i] = float(passages[top])
            out[2 + 2 * i] = float(max(passages[: max(0, top - span + 1)].max(initial=0.0), passages[top + span :].max(initial=0.0)))
        return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Coefficients (the last is the constant) by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(x.shape[1])
        step = np.linalg.solve(h, grad)
        w += np.clip(step, -5, 5)
    return w


class Scorer:
    def __init__(self, models: Models | None, curve: np.ndarray | None):
        self.models, self.curve = models, curve

    def score(self, text: str | None) -> float:
        if self.models is None:
            return 0.0
        z = float(np.dot(self.curve[:-1], self.models.figures(text)) + self.curve[-1])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def labelled_texts(documents: DataFrame, ids: DataFrame, text: str) -> DataFrame:
    """``(doc_id, label, t)`` of the sampled ``ids``, one row for each."""
    rows = documents.select("doc_id", F.col(text).alias("t")).join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("t").alias("t"))


def fit_models(documents: DataFrame, train: DataFrame, text: str, rows: int) -> Models | None:
    """Class models from about ``rows`` labelled rows of each class, with all their words and pairs."""
    counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    ids = sampled(train, "doc_id", min(rows, *counts.values()), "label")
    pairs = written(bigram_counts(labelled_texts(documents, ids, text)), "pairs")
    contexts = [F.sum((F.col(f"c{c}") > 0).cast("long")).alias(f"n{c}") for c in (0, 1)]
    ws = written(pairs.groupBy("w").agg(*contexts), "words")
    if ws.isEmpty():
        return None
    kept = ws.toArrow().sort_by("w")
    words = kept.column("w").to_numpy()
    totals = ws.agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in (0, 1)], F.count(F.lit(1)).alias("types")).first()
    whole = pairs.agg(*[F.sum(f"c{c}").alias(f"n{c}") for c in (0, 1)]).first()
    p = pairs.select("h", "w", *[F.col(f"c{c}").cast("int") for c in (0, 1)]).toArrow()
    h = p.column("h").to_numpy()
    h = np.where(h == _START, len(words), np.searchsorted(words, h))
    count = [p.column(f"c{c}").to_numpy() for c in (0, 1)]
    contexts, types = [np.bincount(h, count[c], len(words) + 1) for c in (0, 1)], np.bincount(h, minlength=len(words) + 1)
    key = h * len(words) + np.searchsorted(words, p.column("w").to_numpy())
    order = np.argsort(key)
    return Models(
        words,
        [kept.column(f"n{c}").to_numpy() for c in (0, 1)],
        [totals[f"n{c}"] for c in (0, 1)],
        shared_counts(documents, text, words),
        contexts,
        (key[order], *[count[c][order] for c in (0, 1)]),
        (totals["types"], types),
        (discounts(ws, "n"), discounts(pairs, "c")),
        [[2 * PRIOR * n[f"n{c}"] / (n["n0"] + n["n1"]) for c in (0, 1)] for n in (totals, whole)],
    )


def figures(documents: DataFrame, models: Models, text: str) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(models)

    @F.arrow_udf("array<double>")
    def of(batch: pa.Array) -> pa.Array:
        return pa.array((shared.value.figures(value.as_py()) for value in batch), pa.list_(pa.float64()))

    return documents.withColumn("figures", of(F.col(text)))


def fit(documents: DataFrame, labels: DataFrame, text: str = "text", rows: int = 3000, column: str = "toxic") -> Scorer:
    """Fit on labelled rows whose crc32 remainder by 5 is not 0: counts on 1 to 3, the curve on 4.

    ``rows`` bounds the labelled rows of each class (the curve takes twice as
    many in all); the shared counts cover all ``documents``.
    """
    train = labelled(labels, column)
    first, second = train.where(remainder("doc_id", 5).isin(1, 2, 3)), train.where(remainder("doc_id", 5) == 4)
    models = fit_models(documents, first, text, rows)
    if models is None:
        return Scorer(None, None)
    for fold in (second, first):
        held = labelled_texts(documents, sampled(fold, "doc_id", 2 * rows), text)
        table = figures(held, models, "t").select("label", "figures").toArrow()
        if len(set(table.column("label").to_pylist())) == 2:
            break
    x = np.array(table.column("figures").to_pylist())
    y = table.column("label").to_numpy().astype(float)
    used = np.arange(x.shape[1])
    while True:  # no figure may count against toxicity the higher it is
        curve = logistic(x[:, used], y)
        if not len(used) or (curve[:-1] >= 0).all():
            break
        used = np.delete(used, curve[:-1].argmin())
    whole = np.zeros(x.shape[1] + 1)
    whole[used], whole[-1] = curve[:-1], curve[-1]
    return Scorer(models, whole)


def score(documents: DataFrame, scorer: Scorer, text: str = "text", into: str = "score") -> DataFrame:
    """``documents`` plus the score of every whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(scorer)

    @F.arrow_udf("double")
    def of(batch: pa.Array) -> pa.Array:
        return pa.array((shared.value.score(value.as_py()) for value in batch), pa.float64())

    return documents.withColumn(into, of(F.col(text)))


def op3_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    docs = documents.select("doc_id", "text")
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
