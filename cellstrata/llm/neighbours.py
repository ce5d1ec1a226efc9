"""Near-duplicate vectors by cross-polytope hashing.

Equal vectors of a label are one node with a count. A node's hash is, for each
of a few pseudo-random rotations (three times: random signs, then a fast
Hadamard transform), the axis and sign of its largest coordinate. Every node
is filed under one bucket of each table and looks into that bucket and the
next most likely ones (multiprobe). Pairs found are verified by their cosine in
double precision, so there is no false link; the number of tables is such that
a pair at the threshold itself is missed with a probability of at most ``miss``
(closer pairs much less).

A bucket of more than ``MANY`` nodes names its smallest node as pivot. Nodes
within half the threshold's angle of a pivot form a cell; all of them are linked
with each other, so they are counted and joined by one edge each, and in such
buckets only nodes of different cells are compared. The pairs of a large group
of near vectors are thus neither made nor stored, and ``n_links`` stays exact.

Cases: vectors that are null, empty, zero or hold null or non-finite
components, and vectors without a label, link with nothing; vectors of
different lengths never link; vectors are scaled by their largest component
first, so very large and very small ones are compared like any other; repeated
ids count as vectors of their own, a null id gets a null component if it links
with nothing; ties need no rule. An empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cellstrata.operators.components import connected_components
from cellstrata.plans.lineage import cut, written


MANY = 128


def scaled(x: np.ndarray) -> np.ndarray:
    """Every row over its largest absolute value, so that squares neither overflow nor vanish."""
    return x / np.abs(x).max(axis=1, keepdims=True)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row (its length is a power of two), scaled to a rotation."""
    n = x.shape[1]
    h = 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


class CrossPolytope:
    """``tables`` hashes of ``parts`` rotations each; ``probes`` buckets to look into."""

    def __init__(self, parts: int, tables: int, probes: int, seed: int = 7):
        self.parts, self.tables, self.probes, self.seed = parts, tables, probes, seed

    def scores(self, x: np.ndarray, table: int, part: int) -> np.ndarray:
        """Coordinates after the rotation, each axis with both signs."""
        width = 1 << max(1, (x.shape[1] - 1).bit_length())
        r = np.random.default_rng([self.seed, width, table, part])
        y = np.zeros((len(x), width))
        y[:, : x.shape[1]] = x
        for _ in range(3):
            y = hadamard(y * r.choice([-1.0, 1.0], width))
        return np.concatenate([y, -y], axis=1)

    def buckets(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own bucket ``[n, tables]`` and buckets to look into ``[n, tables * probes]`` (the own one first)."""
        x = scaled(x)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        own, look = [], []
        for t in range(self.tables):
            codes, costs = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
            for k in range(self.parts):
                s = self.scores(x, t, k)
                keep = min(self.probes, s.shape[1])
                best = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
                value = np.take_along_axis(s, best, 1)
                loss = (value.max(1, keepdims=True) - value) ** 2  # how far the vector is from the other cap
                codes = (codes[:, :, None] * s.shape[1] + best[:, None, :]).reshape(len(x), -1)
                costs = (costs[:, :, None] + loss[:, None, :]).reshape(len(x), -1)
                order = np.argsort(costs, axis=1, kind="stable")[:, : self.probes]
                codes, costs = np.take_along_axis(codes, order, 1), np.take_along_axis(costs, order, 1)
            own.append(codes[:, 0] * self.tables + t)
            look.append(codes * self.tables + t)
        return np.stack(own, 1), np.concatenate(look, 1)


def plan(vectors: int, width: int, threshold: float, miss: float, probes: int = 6, per_bucket: int = 32) -> CrossPolytope:
    """Enough parts that a bucket holds about ``per_bucket`` vectors, and enough tables for ``miss``.

    The chance that one table finds a pair at the threshold is measured on
    random pairs at just that cosine.
    """
    width = max(2, width)
    parts = max(1, math.ceil(math.log(max(2.0, vectors / per_bucket)) / math.log(2 * width)))
    r = np.random.default_rng(11)
    a = r.standard_normal((2000, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.standard_normal((2000, width))
    b -= (a * b).sum(1, keepdims=True) * a
    b = threshold * a + math.sqrt(1 - threshold**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    one = CrossPolytope(parts, 1, probes)
    (own_a, look_a), (own_b, look_b) = one.buckets(a), one.buckets(b)
    found = float(((look_a == own_b).any(1) | (look_b == own_a).any(1)).mean())
    return CrossPolytope(parts, max(1, math.ceil(math.log(miss) / math.log(max(1e-9, 1 - min(0.999, found))))), probes)


def _by_length(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, matrix)`` for each length of list."""
    flat, offsets = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy()
    starts, lengths = offsets[:-1] - offsets[0], np.diff(offsets)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, flat[starts[rows][:, None] + np.arange(n)]


def nodes(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``(label, v, node, copies)`` for every distinct usable vector; ``node`` is its smallest key."""
    v = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))  # no negative zero
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall("v", lambda x: x == 0)
    return (
        vectors.select(F.col(label).alias("label"), v.alias("v"), F.col(key).alias("id"))
        .where(F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(False)) & ~zero)
        .groupBy("label", "v")
        .agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"))
    )


_BUCKET = ["label", "width", "bucket"]


def hashed(distinct: DataFrame, index: CrossPolytope) -> tuple[DataFrame, DataFrame]:
    """``(label, width, bucket, x)`` that nodes are filed under, and ``(label, width, bucket, y)`` that they look into."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, look = [None] * batch.num_rows, [None] * batch.num_rows
            for rows, x in _by_length(batch.column(2)):
                a, b = index.buckets(x)
                for i, o, p in zip(rows.tolist(), a.tolist(), b.tolist()):
                    own[i], look[i] = o, p
            longs = pa.list_(pa.int64())
            width = pa.array(np.diff(batch.column(2).offsets.to_numpy()), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), width, pa.array(own, longs), pa.array(look, longs)], ["node", "label", "width", "own", "look"]
            )

    label = distinct.schema["label"].dataType.simpleString()
    h = distinct.select("node", "label", "v").mapInArrow(codes, f"node long, label {label}, width long, own array<long>, look array<long>")
    h = written(h, "hashes")
    filed = h.select("label", "width", F.explode("own").alias("bucket"), F.col("node").alias("x"))
    return filed, h.select("label", "width", F.explode("look").alias("bucket"), F.col("node").alias("y"))


def similar(pairs: DataFrame, distinct: DataFrame, least: float) -> DataFrame:
    """Those pairs of nodes ``(a, b)`` whose cosine is at least so much."""
    at = distinct.select("node", "v")
    both = pairs.join(at.select(F.col("node").alias("a"), F.col("v").alias("va")), "a").join(at.select(F.col("node").alias("b"), F.col("v").alias("vb")), "b")
    c = cosine("va", "vb")
    return both.where(~F.isnan(c) & (c >= least)).select("a", "b")


def cells(filed: DataFrame, large: DataFrame, distinct: DataFrame, threshold: float) -> DataFrame:
    """``(node, cell)`` of the nodes near a pivot ``p`` of the large buckets."""
    pairs = filed.join(large, _BUCKET).select(F.col("x").alias("a"), F.col("p").alias("b")).distinct()
    half = math.sqrt((1 + threshold) / 2) + 1e-9
    near = similar(pairs.where("a <> b"), distinct, half).union(pairs.where("a = b"))
    return near.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("cell"))


def candidates(filed: DataFrame, asked: DataFrame, large: DataFrame, cell: DataFrame) -> DataFrame:
    """``(a, b)``, a below b: pairs of nodes of one label that share a bucket in some table, but those of one cell in large buckets."""
    pairs = filed.join(large, _BUCKET, "left_anti").join(asked, _BUCKET).select("x", "y")

    def with_cell(rows: DataFrame, name: str, to: str) -> DataFrame:
        own = cell.select(F.col("node").alias(name), F.col("cell").alias(to))
        return rows.join(large.drop("p"), _BUCKET).join(own, name, "left").withColumn(to, F.coalesce(to, name))

    f, a = with_cell(filed, "x", "cx"), with_cell(asked, "y", "cy")
    meet = f.select(*_BUCKET, "cx").distinct().join(a.select(*_BUCKET, "cy").distinct(), _BUCKET).where("cx <> cy")
    pairs = pairs.union(meet.join(f, [*_BUCKET, "cx"]).join(a, [*_BUCKET, "cy"]).select("x", "y"))
    return pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


@F.arrow_udf(T.DoubleType())
def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    out = np.zeros(len(a))
    other = {n.shape[1]: (rows, n) for rows, n in _by_length(b)}
    for rows, x in _by_length(a):
        x, y = scaled(x), scaled(other[x.shape[1]][1])
        out[rows] = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
    return pa.array(out)


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98, miss: float = 1e-6
) -> DataFrame:
    """``(key, n_links, component_id, kept)`` for every row of ``vectors``."""
    distinct = written(nodes(vectors, key, vector, label), "nodes")
    size = distinct.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).agg(F.max("n").alias("n"), F.max("width").alias("width")).first()
    filed, asked = hashed(distinct, plan(size["n"] or 0, size["width"] or 2, threshold, miss))
    large = filed.groupBy(_BUCKET).agg(F.count(F.lit(1)).alias("k"), F.min("x").alias("p"))
    large = cut(large.where(F.col("k") > MANY).select(*_BUCKET, "p"))
    cell = cut(cells(filed, large, distinct, threshold))
    copies = distinct.select("node", "copies")
    links = similar(candidates(filed, asked, large, cell), distinct, threshold)
    links = links.join(cell.select(F.col("node").alias("a"), F.col("cell").alias("ca")), "a", "left").join(cell.select(F.col("node").alias("b"), F.col("cell").alias("cb")), "b", "left")
    links = cut(links.where("ca is null or cb is null or ca <> cb").select("a", "b"))  # those of a cell are counted as such
    of_cell = cell.join(copies, "node").groupBy("cell").agg(F.min("node").alias("least"), F.sum("copies").alias("total"))
    of_cell = cut(cell.join(of_cell, "cell").select("node", "least", "total"))
    component = connected_components(links.union(of_cell.where("node <> least").select("node", "least")), "a", "b")
    both = links.union(links.select("b", "a"))
    degree = (
        both.join(copies.select(F.col("node").alias("b"), "copies"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("others"))
    )
    found = (
        distinct.join(degree, "node", "left")
        .join(of_cell, "node", "left")
        .join(component, "node", "left")
        .select(
            F.col("label").alias("l"),
            "v",
            (F.coalesce("total", "copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"),
            F.coalesce("component", "node").alias("c"),
        )
    )
    rows = vectors.select(
        F.col(key), F.col(label).alias("l"), F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0)).alias("v")
    )
    return rows.join(found, ["l", "v"], "left").select(
        key,
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("c", key).cast("long").alias("component_id"),
        (F.col(key) == F.coalesce("c", key)).alias("kept"),
    )


def op1_near_vectors(embeddings: DataFrame) -> DataFrame:
    return near_duplicates(embeddings.select("vec_id", "embedding", "label"))
