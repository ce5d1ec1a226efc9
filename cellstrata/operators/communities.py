"""Communities of a graph by the Leiden method, in rounds of joins."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cellstrata.operators.graph import normalise_edges
from cellstrata.plans.lineage import written


def _met(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Join of frames of nodes or edges by sort and merge: files of few bytes hold so many nodes that a hash table of them would be large."""
    return a.join(b.hint("merge"), on)


def _coin(node: str, salt: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), node), F.lit(2)) == 0


def _moved(edges: DataFrame, state: DataFrame, twice: float, salt: int) -> DataFrame:
    """One round of local moving: half of the nodes, by hash, go to the neighbouring community of largest gain.

    ``state(node, k, c)``: strength and community. The own community is an
    option of every node, so no move loses; ``moved`` marks those that went.
    Rounds are written, not checkpointed: a checkpoint keeps the plan's estimate
    of its size, a product over joins whose digits double in every round.
    """
    linked = _met(edges, state.select(F.col("node").alias("dst"), "c"), "dst").select(F.col("src").alias("node"), "c", "w")
    options = linked.unionByName(state.select("node", "c", F.lit(0.0).alias("w"))).groupBy("node", "c").agg(F.sum("w").alias("w"))
    volume = state.groupBy("c").agg(F.sum("k").alias("volume"))
    own = state.select("node", "k", F.col("c").alias("now"))
    rest = F.col("volume") - F.when(F.col("c") == F.col("now"), F.col("k")).otherwise(0.0)
    scored = _met(_met(options, volume, "c"), own, "node").withColumn("gain", F.round(F.col("w") - F.col("k") * rest / twice, 9))
    best = scored.groupBy("node").agg(F.first("k").alias("k"), F.first("now").alias("now"), F.max(F.struct("gain", (F.col("c") == F.col("now")).alias("stay"), (-F.col("c")).alias("c"))).alias("best"))
    to = F.when(_coin("node", salt), -F.col("best.c")).otherwise(F.col("now"))
    return written(best.select("node", "k", to.alias("c"), (to != F.col("now")).alias("moved")), "moved")


def local_moving(edges: DataFrame, state: DataFrame, twice: float, salt: int = 0, most: int = 10) -> DataFrame:
    """Rounds of moving until two in a row, which try different halves, move less than a hundredth of the nodes, or ``most``."""
    calm, nodes = 0, state.count()
    for r in range(most):
        state = _moved(edges, state.select("node", "k", "c"), twice, salt + r)
        n = state.where("moved").count()
        calm = calm + 1 if n <= nodes // 100 else 0
        if calm == 2:
            break
    return state.select("node", "k", "c")


def refined(edges: DataFrame, state: DataFrame, twice: float, salt: int = 0, rounds: int = 3) -> DataFrame:
    """``(node, k, c, s)``: parts ``s`` of each community, grown from single nodes that are well linked to the rest of it.

    In each round half of the nodes that still stand alone join the part of
    their community with the largest gain above 0, among parts whose first node
    is of the other half or which have grown before. Nodes and parts with
    fewer links to the rest of the community than expected take no part.
    """
    named = lambda side: state.select(F.col("node").alias(side), F.col("c").alias(f"c_{side}"))
    within = written(_met(_met(edges, named("src"), "src"), named("dst"), "dst").where("c_src = c_dst").select("src", "dst", "w"), "within")
    volume = state.groupBy("c").agg(F.sum("k").alias("kc"))
    parts = written(_met(state, volume, "c").select("node", "k", "c", "kc", F.col("node").alias("s")), "parts")
    for r in range(rounds):
        links = _met(_met(within, parts.select(F.col("node").alias("dst"), F.col("s").alias("to")), "dst"), parts.select(F.col("node").alias("src"), "s"), "src")
        outward = links.where("s <> to").groupBy("s").agg(F.sum("w").alias("out"))
        size = parts.groupBy("s").agg(F.sum("k").alias("ks"), F.count(F.lit(1)).alias("n"), F.first("kc").alias("kc"))
        size = size.join(outward.hint("merge"), "s", "left").withColumn("well", F.coalesce("out", F.lit(0.0)) >= F.col("ks") * (F.col("kc") - F.col("ks")) / twice)
        size = size.where("well").select("s", "ks", "n")
        movers = parts.join(size.where("n = 1").select("s").hint("merge"), "s", "left_semi").where(_coin("node", salt + r)).select(F.col("node").alias("src"), "k")
        targets = size.where((F.col("n") > 1) | ~_coin("s", salt + r)).select(F.col("s").alias("to"), "ks")
        options = _met(_met(links.where("s <> to").groupBy("src", "to").agg(F.sum("w").alias("w")), movers, "src"), targets, "to")
        gain = F.round(F.col("w") - F.col("k") * F.col("ks") / twice, 9)
        best = options.withColumn("gain", gain).where("gain > 0").groupBy("src").agg(F.max(F.struct("gain", (-F.col("to")).alias("to"))).alias("best"))
        joined = parts.join(best.select(F.col("src").alias("node"), (-F.col("best.to")).alias("to")).hint("merge"), "node", "left")
        parts = written(joined.select("node", "k", "c", "kc", F.coalesce("to", "s").alias("s"), F.col("to").isNotNull().alias("joined")), "parts")
        if not parts.where("joined").count():
            break
        parts = parts.drop("joined")
    return parts.select("node", "k", "c", "s")


# ---- a bounded graph in one task ----------------------------------------


def _move(near: list[dict[int, float]], k: list[float], c: list[int], twice: float) -> None:
    """Nodes go to the community of largest gain until none moves; who has a neighbour that moved is asked again."""
    volume: dict[int, float] = {}
    for v, own in enumerate(c):
        volume[own] = volume.get(own, 0.0) + k[v]
    queue, waiting = deque(range(len(c))), [True] * len(c)
    while queue:
        v = queue.popleft()
        waiting[v] = False
        links = {c[v]: 0.0}
        for u, w in near[v].items():
            links[c[u]] = links.get(c[u], 0.0) + w
        volume[c[v]] -= k[v]
        to = max(links, key=lambda x: (round(links[x] - k[v] * volume.get(x, 0.0) / twice, 9), x == c[v], -x))
        volume[to] = volume.get(to, 0.0) + k[v]
        if to != c[v]:
            c[v] = to
            for u in near[v]:
                if c[u] != to and not waiting[u]:
                    waiting[u] = True
                    queue.append(u)


def _split(near: list[dict[int, float]], k: list[float], c: list[int], twice: float) -> list[int]:
    """The part of each node: well linked nodes that stand alone join the part of their community with the largest gain."""
    n = len(c)
    part, alone, size = list(range(n)), [True] * n, list(k)
    out = [sum(w for u, w in near[v].items() if c[u] == c[v]) for v in range(n)]
    volume: dict[int, float] = {}
    for v, own in enumerate(c):
        volume[own] = volume.get(own, 0.0) + k[v]
    well = lambda p, total: out[p] >= size[p] * (total - size[p]) / twice - 1e-12
    for v in range(n):
        total = volume[c[v]]
        if not alone[v] or not well(v, total):
            continue
        links: dict[int, float] = {}
        for u, w in near[v].items():
            if c[u] == c[v]:
                links[part[u]] = links.get(part[u], 0.0) + w
        gains = {p: round(w - k[v] * size[p] / twice, 9) for p, w in links.items() if p != v and well(p, total)}
        to = max(gains, key=lambda p: (gains[p], -p), default=v)
        if to != v and gains[to] > 0:
            alone[v] = alone[to] = False
            part[v], size[to], size[v] = to, size[to] + k[v], 0.0
            out[to] += out[v] - 2 * links[to]
    return part


def settled(near: list[dict[int, float]], k: list[float], c: list[int], twice: float) -> list[int]:
    """Communities of the nodes of a graph in memory, from those in ``c`` on; all levels."""
    place = list(range(len(c)))
    while True:
        _move(near, k, c, twice)
        part = _split(near, k, c, twice)
        names = {p: i for i, p in enumerate(sorted(set(part)))}
        if len(names) == len(part):
            return [c[v] for v in place]
        merged: list[dict[int, float]] = [{} for _ in names]
        strength, community = [0.0] * len(names), [0] * len(names)
        for v, p in enumerate(part):
            i = names[p]
            strength[i] += k[v]
            community[i] = c[v]
            for u, w in near[v].items():
                if (j := names[part[u]]) != i:
                    merged[i][j] = merged[i].get(j, 0.0) + w
        place = [names[part[v]] for v in place]
        near, k, c = merged, strength, community


def _in_one_task(edges: DataFrame, state: DataFrame, twice: float) -> DataFrame:
    """``(node, c)`` of a graph that was checked to be small."""
    sides = edges.select(F.col("src").alias("node"), "dst", "w")
    rows = state.select("node", "k", "c").join(sides, "node", "left")

    def solve(table: pa.Table) -> pa.Table:
        t = table.sort_by([("node", "ascending")]).to_pydict()
        names = sorted(set(t["node"]))
        at = {v: i for i, v in enumerate(names)}
        near: list[dict[int, float]] = [{} for _ in names]
        k, c, first = [0.0] * len(names), [0] * len(names), {}
        for v, u, w, strength, own in zip(t["node"], t["dst"], t["w"], t["k"], t["c"]):
            i = at[v]
            k[i], c[i] = strength, first.setdefault(own, i)
            if u is not None:
                near[i][at[u]] = w
        found = settled(near, k, c, twice)
        return pa.table({"node": pa.array(names, pa.int64()), "c": pa.array([names[x] for x in found], pa.int64())})

    one = rows.select(F.col("node").cast("long"), "dst", "w", "k", F.col("c").cast("long"), F.lit(0).alias("g"))
    return one.groupBy("g").applyInArrow(lambda table: solve(table), "node long, c long")


def _modularity(edges: DataFrame, state: DataFrame, loops: float, twice: float) -> float:
    """``loops``: weight, both ways, within the nodes themselves."""
    named = lambda side: state.select(F.col("node").alias(side), F.col("c").alias(f"c_{side}"))
    inside = _met(_met(edges, named("src"), "src"), named("dst"), "dst").where("c_src = c_dst").agg(F.sum("w")).first()[0] or 0.0
    squares = state.groupBy("c").agg(F.sum("k").alias("v")).agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0
    return (inside + loops) / twice - squares / twice**2


def communities(edges: DataFrame, levels: int = 20, one_task: int = 200_000) -> DataFrame:
    """``(node, community)`` of every node of ``edges(src, dst)``; a community has the name of its smallest node.

    Each level moves nodes between communities, splits the communities into
    well linked parts, and makes these the nodes of the next level, which
    begins with the communities; it ends when modularity stops rising, or when
    no two nodes form a part. A level of at most ``one_task`` edges (both ways)
    is finished in one task, which moves node after node and so needs no
    rounds. All weights are 1; directions, loops and repeated edges do not count.
    """
    e = written(normalise_edges(edges).withColumn("w", F.lit(1.0)), "edges")
    state = written(e.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")).withColumn("c", F.col("node")), "nodes")
    twice = state.agg(F.sum("k")).first()[0]
    if not twice:
        return state.select("node", F.col("c").alias("community"))
    best, loops, place, found = -1.0, 0.0, state.select("node", F.col("node").alias("now")), None
    for level in range(levels):
        if e.count() <= one_task:
            found = written(_met(place, _in_one_task(e, state, twice).withColumnRenamed("node", "now"), "now").select("node", "c"), "found")
            break
        state = local_moving(e, state, twice, 100 * level)
        quality = _modularity(e, state, loops, twice)
        if quality <= best + 1e-9:
            break
        best = quality
        found = written(_met(place, state.select(F.col("node").alias("now"), "c"), "now").select("node", "c"), "found")
        parts = refined(e, state, twice, 100 * level + 50)
        part = parts.select("node", "s")
        nodes = written(parts.groupBy("s").agg(F.sum("k").alias("k"), F.first("c").alias("c")), "nodes")
        if nodes.count() == part.count():
            break
        place = written(_met(place, part.select(F.col("node").alias("now"), "s"), "now").select("node", F.col("s").alias("now")), "place")
        named = _met(_met(e, part.select(F.col("node").alias("src"), F.col("s").alias("a")), "src"), part.select(F.col("node").alias("dst"), F.col("s").alias("b")), "dst")
        e = written(named.where("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")), "edges")
        loops = twice - (e.agg(F.sum("w")).first()[0] or 0.0)
        state = nodes.withColumnRenamed("s", "node")
    first = found.groupBy("c").agg(F.min("node").alias("community"))
    return _met(found, first, "c").select("node", "community")


def modularity(edges: DataFrame, state: DataFrame) -> float:
    """Of a partition ``state(node, community)``."""
    e = normalise_edges(edges).withColumn("w", F.lit(1.0))
    k = e.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k"))
    own = k.join(state.select("node", F.col("community").alias("c")), "node")
    twice = own.agg(F.sum("k")).first()[0]
    return _modularity(e, own, 0.0, twice) if twice else 0.0
