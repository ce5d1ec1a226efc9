"""Exact n-gram Jaccard join with a token-group matrix.

A document is the set of its distinct word n-grams. Documents with equal sets
are one. The join runs in two steps; both only ever add links that have been
verified on the whole sets.

1. Groups. Documents that agree in two of a few minimum hashes are compared
   with the most central of them; the components of these links, cut into parts of
   bounded size, are the groups of similar documents.
2. Token-group matrix. The tokens of all sets are in one fixed order, common
   ones last; for a document of n tokens, any partner holds at least
   a = ceil(t * n) of them, hence at least k of its first n - a + k tokens. An
   index of these leading tokens, with the range of set sizes of each group,
   gives the groups in which a document meets k tokens, where their sizes and
   places allow it. Of each such group of several documents the union of all
   its members' tokens is stored, and only where the document's whole set shares
   enough with the union (a group of one is its own union) is the group opened
   and the document compared with its members. Groups of the same component
   need not be opened: their documents are linked already.

The order of the tokens takes common ones from counts over all documents; any
order gives the same links, a good one opens few groups. A token that is not
among the common ones is held by a small share of the documents, so its rows can
meet in one task; the common ones, of bounded number, are aggregated in parts.

Cases: null and empty texts and texts of blanks have an empty set and link with
nothing; a text with fewer words than ``n`` is one token, the whole sequence;
rows that repeat an id are one node; a null id links with nothing and has a
null component; of documents with equally many common tokens the smallest id is
the centre; a text is one set whatever its length; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from cellstrata.llm.memory import batches_of, tidy
from cellstrata.operators.components import connected_components
from cellstrata.plans.lineage import cut, written

_HASHES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_P = np.uint64(0x100000001B3)
_M = np.uint64(0xFF51AFD7ED558CCD)
EXTRA = 3  # k above
BATCH = 1000
_BROADCAST = 1_000_000  # rows of two or three numbers


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M
    return h ^ (h >> np.uint64(29))


def token_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit tokens of a text."""
    ws = text.encode().lower().split() if text else []
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    if len(ws) < n:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(ws))], np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = _mix(out * _P + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def common_tokens(documents: DataFrame, text: str, n: int, most: int = 1 << 18, at_once: int = 1_000_000, share: float = 0.0005) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that a share of the documents of some block hold, with their counts: at most ``most``, rarest first.

    A block is what a task has read when it holds ``at_once`` tokens.
    """

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, size = [], 0

        def block() -> pa.RecordBatch:
            token, n_docs = np.unique(np.concatenate(sets), return_counts=True)
            some = n_docs >= max(3, share * len(sets))
            return pa.RecordBatch.from_pydict({"token": token[some].view(np.int64), "n": n_docs[some]})

        for batch in batches:
            for value in batch.column(0):
                sets.append(token_set(value.as_py(), n))
                size += len(sets[-1])
                if size >= at_once:
                    yield block()
                    sets, size = [], 0
        if sets:
            yield block()

    counts = written(
        documents.select(text).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "common"
    )
    total, least = 0, 1 << 62
    for r in counts.groupBy(F.least("n", F.lit(100_000)).alias("m")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("m")).collect():
        if total + r["k"] > most:
            break
        total, least = total + r["k"], r["m"]
    table = counts.where(F.col("n") >= least).toArrow()
    token, size = table.column("token").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(token)
    return token[order], size[order]


def need(n: np.ndarray | int, percent: int):
    """ceil(percent / 100 * n)"""
    return -(-percent * n // 100)


def signatures(documents: DataFrame, key: str, text: str, n: int, percent: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``(id, n, core, f1, f2, mins, rare, lead)`` of each document.

    Size of its set, common tokens in it (of a thousand), fingerprint, minimum
    hashes, leading tokens, and how many of these, the first ones, are not common.
    """
    shared = documents.sparkSession.sparkContext.broadcast(common)

    def one(s: np.ndarray) -> tuple:
        token, count = shared.value
        size = len(s)
        if not size:
            return 0, 0, None, None, [], 0, []
        mins = [int(np.min(_mix(s * m)).view(np.int64)) for m in _HASHES]
        rank = np.zeros(size, np.int64)
        if len(token):
            at = np.minimum(np.searchsorted(token, s), len(token) - 1)
            rank = np.where(token[at] == s, count[at], 0)
        least = need(size, percent)
        lead = s[np.lexsort((s, rank))[: size - least + min(EXTRA, least)]]
        f = xxhash.xxh3_128_digest(s.tobytes())
        f1, f2 = (int.from_bytes(x, "little", signed=True) for x in (f[:8], f[8:]))
        known = int(np.count_nonzero(rank))
        return size, 1000 * known // size, f1, f2, mins, min(len(lead), size - known), lead.view(np.int64)

    def signed(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64())]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
        return pa.RecordBatch.from_arrays([ids, *columns], ["id", "n", "core", "f1", "f2", "mins", "rare", "lead"])

    @tidy
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield signed(part.column(0), [one(token_set(value.as_py(), n)) for value in part.column(1)])

    return documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(
        sign, "id long, n long, core long, f1 long, f2 long, mins array<long>, rare long, lead array<long>"
    )


def small(df: DataFrame) -> DataFrame:
    """``df``, a written table of a few numbers a row, to be broadcast if it has at most ``_BROADCAST`` rows."""
    return F.broadcast(df) if df.count() <= _BROADCAST else df


@F.arrow_udf(T.LongType())
def shared_tokens(a: pa.Array, b: pa.Array) -> pa.Array:
    """How many tokens two packed sets share."""
    out = []
    for x, y in zip(a, b):
        both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
        both.sort()
        out.append(int(np.count_nonzero(both[1:] == both[:-1])))
    return pa.array(out, pa.int64())


class Sets:
    """Whole token sets of ``documents``, packed, made anew where they are needed; ``repeats``: ids may occur in several rows."""

    def __init__(self, documents: DataFrame, key: str, text: str, n: int, repeats: bool):
        self.rows, self.n, self.repeats = documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")), n, repeats

    def of(self, ids: DataFrame) -> DataFrame:
        """``(id, s)`` of ``ids``, a written frame of distinct ids."""
        n = self.n

        @tidy
        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                packed = [token_set(value.as_py(), n).tobytes() for value in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["id", "s"])

        found = self.rows.join(small(ids), "id", "left_semi").mapInArrow(sets, "id long, s binary")
        return found.dropDuplicates(["id"]) if self.repeats else found

    def verified(self, pairs: DataFrame, percent: int) -> DataFrame:
        """Those pairs ``(a, b)`` whose whole sets have the similarity."""
        found = self.of(cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()))
        size = lambda s: F.octet_length(s) / 8
        both = (
            pairs.join(found.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
            .join(found.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
            .select("a", "b", (size("sa") + size("sb")).alias("total"), shared_tokens("sa", "sb").alias("same"))
        )
        return both.where(100 * F.col("same") >= percent * (F.col("total") - F.col("same"))).select("a", "b")

    def unions(self, members: DataFrame) -> DataFrame:
        """``(g, u)``: the token union of each group of ``members(g, id)``, a written frame; groups are of bounded size."""

        def unite(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            union = np.zeros(0, np.uint64)
            for batch in batches:
                for s in batch.column(1):
                    union = np.union1d(union, np.frombuffer(s.as_buffer(), np.uint64))
            yield pa.RecordBatch.from_pydict({"g": pa.array([key[0].as_py()], pa.int64()), "u": pa.array([union.tobytes()], pa.binary())})

        sets = self.of(cut(members.select("id").distinct()))
        return members.join(sets, "id").select("g", "s").groupBy("g").applyInArrow(unite, "g long, u binary")


def similar_to_centre(sets: DataFrame) -> DataFrame:
    """Pairs of a document and the centre of those that share one of its minimum hashes, where they share two.

    The centre has the largest share of common tokens (of equals the smallest
    id): of edited copies of a text, the one with the fewest edits, to which
    most others are similar.
    """
    keyed = sets.select("id", "core", F.posexplode("mins").alias("j", "m"))
    centre = keyed.groupBy("j", "m").agg(F.max(F.struct("core", (-F.col("id")).alias("id"))).alias("c"), F.count(F.lit(1)).alias("k"))
    centre = centre.where("k > 1").select("j", "m", (-F.col("c.id")).alias("c"))
    return (
        keyed.join(centre, ["j", "m"])
        .where("c <> id")
        .groupBy(F.least("c", "id").alias("a"), F.greatest("c", "id").alias("b"))
        .agg(F.count(F.lit(1)).alias("k"))
        .where("k >= 2")
        .select("a", "b")
    )


def met_groups(sets: DataFrame, percent: int) -> DataFrame:
    """``(id, g, share)``: groups of other components in which a document meets enough leading tokens.

    ``sets`` has ``id, n, rare, lead, comp, grp``; ``share`` is what the document
    and any partner in the group must have in common at least.
    """
    token = sets.select("id", "comp", "rare", F.posexplode("lead").alias("pos", "token"))
    w = Window.partitionBy("token")
    few = token.where("pos < rare").withColumn("low", F.min("comp").over(w)).withColumn("high", F.max("comp").over(w))
    many = token.where("pos >= rare")
    ends = cut(many.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high"))
    many = many.join(small(ends), "token")
    token = few.select("token", "id", "pos", "low", "high").union(many.select("token", "id", "pos", "low", "high"))
    token = cut(token.where("low < high").select("token", "id", "pos"))
    k = F.least(F.lit(EXTRA), F.ceil(F.col("n") * percent / 100))
    owner = cut(sets.select("id", "n", "comp", "grp", k.alias("k")).join(token.select("id").distinct(), "id", "left_semi").distinct())
    token = cut(token.join(small(owner), "id"))
    matrix = token.groupBy("token", "grp").agg(
        F.first("comp").alias("g_comp"),
        F.min("n").alias("low"),
        F.max("n").alias("high"),
        F.min("k").alias("g_k"),
        F.max(F.col("n") - F.col("pos")).alias("rest"),
    )
    # what a document and the smallest partner in the group must share at least, and how many of it we ask for
    share = F.greatest(F.ceil(F.col("n") * percent / 100), F.ceil((F.col("n") + F.col("low")) * percent / (100 + percent)))
    asked = F.least("k", "g_k")
    return (
        token.join(matrix.withColumnRenamed("grp", "g"), "token")
        .where((F.col("g_comp") < F.col("comp")) & (100 * F.col("high") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("low")))
        .where((F.col("pos") <= F.col("n") - share + asked - 1) & (F.col("rest") >= share - asked + 1))
        .groupBy("id", "n", "k", "g")
        .agg(F.count(F.lit(1)).alias("met"), F.min("g_k").alias("g_k"))
        .where(F.col("met") >= asked)
        .select("id", "g", "n", F.ceil(F.col("n") * percent / 100).alias("share"))
    )


def open_groups(sets: DataFrame, whole: Sets, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of documents of different components that the token-group matrix leaves to compare."""
    met = cut(met_groups(sets, percent))
    members = sets.select(F.col("grp").alias("g"), F.col("id").alias("other"), F.col("n").alias("m"))
    members = cut(members.join(small(cut(met.select("g").distinct())), "g", "left_semi"))
    several = cut(members.groupBy("g").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("g"))
    doubtful = cut(met.join(small(several), "g", "left_semi"))
    union = whole.unions(cut(members.join(small(several), "g", "left_semi").select("g", F.col("other").alias("id"))))
    asking = whole.of(cut(doubtful.select("id").distinct()))
    opened = doubtful.join(union, "g").join(asking, "id").select("id", "g", "n", "share", shared_tokens("s", "u").alias("same")).where("same >= share")
    met = met.join(small(several), "g", "left_anti").unionByName(opened.drop("same"))
    return (
        met.join(members, "g")
        .where((100 * F.col("m") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("m")))
        .select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    )


def join_groups(documents: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75, group: int = 64) -> DataFrame:
    """``(id, n, component)`` for every document; ``component`` is the smallest id reachable by links.

    Its jobs run with Arrow batches of at most ``BATCH`` rows: a batch of long
    texts, or of pairs of their sets, is in memory on both sides of the pipe.
    """
    with batches_of(documents.sparkSession, BATCH):
        signed = written(signatures(documents, key, text, n, percent, common_tokens(documents, text, n)), "signed")
        ids = signed.agg(F.count("id").alias("rows"), F.count_distinct("id").alias("ids")).first()
        whole = Sets(documents, key, text, n, ids["rows"] > ids["ids"])
        distinct = cut(signed.where("n > 0 and id is not null").groupBy("f1", "f2").agg(F.min("id").alias("node")))
        nodes = cut(distinct.select(F.col("node").alias("id")).distinct())
        sets = signed.select("id", "n", "core", "mins", "rare", "lead").join(small(nodes), "id", "left_semi")

        first = cut(whole.verified(cut(similar_to_centre(sets)), percent))
        near = connected_components(first, "a", "b")
        parts = near.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / group).alias("parts"))
        part = F.pmod(F.xxhash64("node"), F.col("parts"))
        near = cut(near.join(parts, "component").select(F.col("node").alias("id"), "component", F.xxhash64("component", part).alias("part")))
        grouped = (
            sets.select("id", "n", "rare", "lead")
            .join(small(near), "id", "left")
            .select("id", "n", "rare", "lead", F.coalesce("component", "id").alias("comp"), F.coalesce("part", F.xxhash64("id", F.lit(0))).alias("grp"))
        )
        second = whole.verified(cut(open_groups(grouped, whole, percent)), percent)
        links = connected_components(first.union(second), "a", "b").withColumnRenamed("component", "c")
    node = distinct.join(links, "node", "left").select("f1", "f2", F.coalesce("c", "node").alias("c"))
    return signed.select("id", "n", "f1", "f2").join(node, ["f1", "f2"], "left").select(
        "id", "n", F.when(F.col("id").isNotNull(), F.coalesce("c", "id")).alias("component")
    )


def op5_jaccard(documents: DataFrame) -> DataFrame:
    return join_groups(documents.select("doc_id", "text")).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")
    )
