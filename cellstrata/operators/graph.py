"""Contact graph and neighbourhoods (G1-G12). Edges are ``(src, dst)`` in both directions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cellstrata.functions.compare import compared
from cellstrata.operators.select import effective_class
from cellstrata.plans.lineage import cut, large, small, written


def normalise_edges(edges: DataFrame) -> DataFrame:
    """Both directions, no loops, each once."""
    e = edges.select("src", "dst").where("src <> dst")
    return e.union(e.select("dst", "src")).distinct()


def _around(df: DataFrame, size: float, prefix: str) -> DataFrame:
    """Each point in its own square of the grid and the eight around it."""
    steps = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    return df.withColumn("bx", F.explode(F.transform(steps, lambda k: F.floor(F.col(f"{prefix}x") / size) + k))).withColumn(
        "by", F.explode(F.transform(steps, lambda k: F.floor(F.col(f"{prefix}y") / size) + k))
    )


def near_pairs(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """``(a, ax, ay, b, bx_, by_, d2)``: points ``(id, x, y)`` of either frame at most ``radius`` apart, by an equi join on grid squares.

    Points are dealt to tasks before each is made nine, as one task may read
    them all, and meet in a sort-merge join: files of few bytes may hold so many
    points that a hash table of them in every task would be large.
    """
    left = a.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    left = left.withColumn("bx", F.floor(F.col("ax") / radius)).withColumn("by", F.floor(F.col("ay") / radius))
    right = _around(b.select(F.col("id").alias("b"), F.col("x").alias("px"), F.col("y").alias("py")).repartition("b"), radius, "p").hint("merge")
    d2 = (F.col("ax") - F.col("px")) * (F.col("ax") - F.col("px")) + (F.col("ay") - F.col("py")) * (F.col("ay") - F.col("py"))
    return left.join(right, ["bx", "by"]).withColumn("d2", d2).where(F.col("d2") <= float(radius) * float(radius)).drop("bx", "by")


def _points(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("cell_id").alias("id"), "x", "y")


def radius_graph(cells: DataFrame, radius: float) -> DataFrame:
    p = _points(cells)
    return near_pairs(p, p, radius).where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def knn_graph(cells: DataFrame, k: int, radius: float) -> DataFrame:
    """The ``k`` nearest within ``radius``, ties by id; made symmetric."""
    p = _points(cells)
    w = Window.partitionBy("a").orderBy("d2", "b")
    near = near_pairs(p, p, radius).where("a <> b").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return normalise_edges(near.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def delaunay_edges(cells: DataFrame, max_radius: float) -> DataFrame:
    """Edges of triangles whose circumcircle of radius up to ``max_radius`` holds no other point inside.

    Points on the circle do not count as inside, so of co-circular points all
    diagonals are edges.
    """
    p = _points(cells)
    pairs = cut(near_pairs(p, p, 2 * max_radius).where("a < b"))
    ab = pairs.select("a", "ax", "ay", "b", F.col("px").alias("b_x"), F.col("py").alias("b_y"))
    ac = pairs.select("a", F.col("b").alias("c"), F.col("px").alias("c_x"), F.col("py").alias("c_y"))
    t = ab.join(ac, "a").where("b < c")
    bx, by, cx, cy = (F.expr(e) for e in ("b_x - ax", "b_y - ay", "c_x - ax", "c_y - ay"))
    t = t.withColumn("d", 2 * (bx * cy - by * cx)).where("abs(d) > 1e-9")
    b2, c2 = bx * bx + by * by, cx * cx + cy * cy
    t = t.withColumn("ux", (cy * b2 - by * c2) / F.col("d")).withColumn("uy", (bx * c2 - cx * b2) / F.col("d"))
    t = t.withColumn("r2", F.expr("ux * ux + uy * uy")).where(F.col("r2") <= float(max_radius) ** 2)
    t = cut(t.select("a", "b", "c", "r2", F.expr("ax + ux").alias("x"), F.expr("ay + uy").alias("y")))
    centres = t.select(F.struct("a", "b", "c", "r2").alias("id"), "x", "y")
    hit = near_pairs(centres, p, max_radius).where("d2 < a.r2 * (1 - 1e-9) and b <> a.a and b <> a.b and b <> a.c")
    empty = t.join(hit.select("a.a", "a.b", "a.c").distinct(), ["a", "b", "c"], "left_anti")
    sides = F.array(*[F.struct(F.col(s).alias("src"), F.col(d).alias("dst")) for s, d in (("a", "b"), ("a", "c"), ("b", "c"))])
    return normalise_edges(empty.select(F.explode(sides).alias("e")).select("e.src", "e.dst"))


def khop(edges: DataFrame, seeds: DataFrame, k: int, include_self: bool = False) -> DataFrame:
    """``(seed, cell_id, hop)``: cells within ``k`` steps of each seed ``(cell_id)``, each once."""
    frontier = seeds.select(F.col("cell_id").alias("seed"), "cell_id", F.lit(0).alias("hop")).distinct()
    seen = frontier
    step = edges.select(F.col("src").alias("cell_id"), F.col("dst").alias("next"))
    step = cut(step) if k > 1 else step  # else every step would make the edges anew
    for hop in range(1, k + 1):
        reached = frontier.join(large(step), "cell_id").select("seed", F.col("next").alias("cell_id")).distinct()
        frontier = reached.join(large(seen.select("seed", "cell_id")), ["seed", "cell_id"], "left_anti").withColumn("hop", F.lit(hop))
        frontier = cut(frontier) if k > 1 else frontier
        seen = seen.unionByName(frontier)
    return seen if include_self else seen.where("hop > 0")


def neighbourhood_composition(cells: DataFrame, edges: DataFrame, k: int = 1, with_self: bool = False) -> DataFrame:
    """``(cell_id, classification, n, prob)`` for every cell and class.

    ``n`` counts the cell itself; ``prob`` divides by the number of other cells
    in reach (of all cells in reach if ``with_self``), and is null without any.
    """
    own = cells.select("cell_id", "classification")
    near = khop(edges, cells.select("cell_id"), k, include_self=True)
    size = near.groupBy("seed").agg((F.count(F.lit(1)) - (0 if with_self else 1)).alias("size"))
    counted = near.join(large(own), "cell_id").where("classification is not null").groupBy("seed", "classification").agg(F.count(F.lit(1)).alias("n"))
    classes = own.select("classification").where("classification is not null").distinct()
    grid = own.select(F.col("cell_id").alias("seed")).crossJoin(small(cut(classes)))
    return (
        grid.join(large(counted), ["seed", "classification"], "left")
        .join(large(size), "seed")
        .select(
            F.col("seed").alias("cell_id"),
            "classification",
            F.coalesce("n", F.lit(0)).alias("n"),
            F.when(F.col("size") > 0, F.coalesce("n", F.lit(0)) / F.col("size")).alias("prob"),
        )
    )


def neighbourhood_enrichment(cells: DataFrame, edges: DataFrame, targets: Sequence[str], k: int = 2, by: str = "detection", annotations: DataFrame | None = None) -> DataFrame:
    """``(cell_id, total, prob)``: cells in reach including the cell itself, and the share of target classes among them.

    ``by="annotation"`` takes the class of each cell's annotation in place of its own.
    """
    near = khop(edges, cells.select("cell_id"), k, include_self=True)
    hit = F.coalesce(F.col("effective").isin(*targets), F.lit(False)).cast("int")
    return (
        near.join(large(effective_class(cells, annotations, by).select("cell_id", "effective")), "cell_id")
        .groupBy(F.col("seed").alias("cell_id"))
        .agg(F.count(F.lit(1)).alias("total"), F.avg(hit).alias("prob"))
    )


#: Cells of a block, about.
BLOCK = 16_384


def spatial_blocks(cells: DataFrame, most: int) -> DataFrame:
    """``(cell_id, block)``: grid squares of about ``most`` cells; a square with more is dealt to several blocks by hash, and so are cells without a place, or all where none has one."""
    if not {"x", "y"} <= set(cells.columns):
        return cells.select("cell_id", F.pmod(F.xxhash64("cell_id"), F.lit(math.ceil(cells.count() / most) or 1)).alias("block"))
    c = cut(cells.select("cell_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    size = c.agg(F.count(F.lit(1)).alias("n"), *[f(v).alias(f"{f.__name__}_{v}") for v in "xy" for f in (F.min, F.max)]).first()
    wide, high = ((size[f"max_{v}"] or 0.0) - (size[f"min_{v}"] or 0.0) for v in "xy")
    side = max(math.sqrt(max(wide, 1e-9) * max(high, 1e-9) * most / max(1, size["n"])), 1e-9)
    side = side if math.isfinite(side) else 1.0
    at = lambda v: F.coalesce(F.floor((F.col(v) - F.lit(size[f"min_{v}"])) / side), F.lit(-1))
    c = c.withColumns({"bx": at("x"), "by": at("y")})
    deal = c.groupBy("bx", "by").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts"))
    return c.join(deal, ["bx", "by"]).select("cell_id", F.xxhash64("bx", "by", F.pmod(F.xxhash64("cell_id"), F.col("parts"))).alias("block"))


_RELAXED = "block long, cell_id long, layer long, own boolean"


def _relaxed(max_layers: int):
    """Least layers within a block, from those of its cells that are given on; then what its border cells say to other blocks."""
    form = pa.schema([("block", pa.int64()), ("cell_id", pa.int64()), ("layer", pa.int64()), ("own", pa.bool_())])

    def relax(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        kind, src, dst, other, layer = (table.column(c).to_numpy() for c in ("kind", "src", "dst", "other", "layer"))
        names, at = np.unique(src, return_inverse=True)
        far = np.iinfo(np.int64).max // 2
        best, known = np.full(len(names), far), np.full(len(names), far)
        np.minimum.at(best, at[kind != 0], layer[kind != 0])
        np.minimum.at(known, at[kind == 1], layer[kind == 1])
        a, to, there = at[kind == 0], dst[kind == 0], other[kind == 0]
        here = there == block
        ends = np.searchsorted(names, to[here]).clip(0, len(names) - 1)
        starts, ends = a[here][names[ends] == to[here]], ends[names[ends] == to[here]]
        while True:
            step = best.copy()
            np.minimum.at(step, ends, best[starts] + 1)
            if max_layers:
                step[step > max_layers] = far
            if (step == best).all():
                break
            best = step
        some = best < far
        said = ~here & (best[a] < known[a])  # only of cells that came nearer
        if max_layers:
            said &= best[a] < max_layers
        out = [
            np.concatenate([np.full(int(some.sum()), block), there[said]]),
            np.concatenate([names[some], to[said]]),
            np.concatenate([best[some], best[a][said] + 1]),
        ]
        own = np.arange(len(out[0])) < int(some.sum())
        return pa.table([*map(pa.array, out), pa.array(own)], schema=form)

    return relax


def _layers(target: DataFrame, other: DataFrame, edges: DataFrame, max_layers: int, cells: DataFrame) -> DataFrame:
    """Layers by relaxation within spatial blocks; only what cells at the border of a block say goes on to the next round, and only to the blocks it concerns."""
    target = cut(target)
    e = cut(edges.select(F.col("src").alias("cell_id"), F.col("dst").alias("next")).join(large(target), "cell_id", "left_semi"))
    first = e.join(large(other.select(F.col("cell_id").alias("next"))), "next", "left_semi").select("cell_id").distinct()
    place = cut(spatial_blocks(cells.join(large(target), "cell_id", "left_semi"), BLOCK))
    links = e.join(large(place), "cell_id").join(large(place.select(F.col("cell_id").alias("next"), F.col("block").alias("other"))), "next")
    zero = lambda c: F.lit(0).cast("long").alias(c)
    links = written(links.select("block", F.lit(0).alias("kind"), F.col("cell_id").alias("src"), F.col("next").alias("dst"), "other", zero("layer")), "links")
    said = cut(first.join(large(place), "cell_id").select("block", "cell_id", F.lit(1).cast("long").alias("layer")))
    state = said.limit(0)
    while not said.isEmpty():
        active = small(cut(said.select("block").distinct()))
        value = lambda df, kind: df.select("block", F.lit(kind).alias("kind"), F.col("cell_id").alias("src"), zero("dst"), zero("other"), "layer")
        rows = links.join(active, "block", "left_semi").unionByName(value(state.join(active, "block", "left_semi"), 1)).unionByName(value(said, 2))
        out = written(rows.groupBy("block").applyInArrow(_relaxed(max_layers), _RELAXED), "layers")
        state = cut(state.join(active, "block", "left_anti").unionByName(out.where("own").drop("own")))
        said = cut(out.where("not own").groupBy("block", "cell_id").agg(F.min("layer").alias("layer")))
    return state.select("cell_id", F.col("layer").cast("int").alias("layer"))


def boundary_layers(cells: DataFrame, edges: DataFrame, targets: Sequence[str], max_layers: int = 0) -> DataFrame:
    """``(cell_id, layer)``: 1 for targets that touch a cell of another class, one more for each step inward; 0 layers: no limit.

    A null class is neither target nor opponent; targets out of reach have no row.
    """
    c = F.col("classification")
    return _layers(cells.where(c.isin(*targets)).select("cell_id"), cells.where(~c.isin(*targets)).select("cell_id"), edges, max_layers, cells)


def boundary_layers_by_measurement(
    cells: DataFrame, measurements: DataFrame, edges: DataFrame, name: str, op: str, threshold: float, max_layers: int = 0
) -> DataFrame:
    """As ``boundary_layers``, targets being the cells whose measurement compares so; a missing value is an opponent."""
    value = measurements.where(F.col("name") == name).select("cell_id", "value")
    hit = F.coalesce(compared(F.col("value"), op, threshold), F.lit(False))
    marked = cells.select("cell_id").join(large(value), "cell_id", "left").select("cell_id", hit.alias("hit"))
    return _layers(marked.where("hit").select("cell_id"), marked.where("not hit").select("cell_id"), edges, max_layers, cells)


def require_measurement(measurements: DataFrame, name: str) -> int:
    """Number of cells that have the measurement; without any, an error that lists the names there are."""
    n = measurements.where(F.col("name") == name).select("cell_id").distinct().count()
    if n == 0:
        names = [r["name"] for r in measurements.select("name").distinct().orderBy("name").limit(100).collect()]
        raise ValueError(f"no cell has the measurement {name!r}; there are: {', '.join(names)}")
    return n


def layer_summary(layers: DataFrame, targets: DataFrame) -> DataFrame:
    """``(layer, n)``; layer 0 counts the targets ``(cell_id)`` that no layer reached."""
    reached = layers.groupBy("layer").agg(F.count(F.lit(1)).alias("n"))
    rest = targets.join(large(layers), "cell_id", "left_anti").agg(F.lit(0).alias("layer"), F.count(F.lit(1)).alias("n"))
    return reached.unionByName(rest)


def dense_index(df: DataFrame, key: str, name: str = "row_idx") -> DataFrame:
    """``df`` with 0, 1, 2... in the order of ``key``: range partitions, counts of them, and a rank within each."""
    ranged = df.repartitionByRange(F.col(key)).withColumn("__p", F.spark_partition_id())
    ranged = cut(ranged)
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__p").orderBy(key)) - 1
    return ranged.withColumn("__r", rank).join(F.broadcast(before), "__p").withColumn(name, F.col("__r") + F.col("__before")).drop("__p", "__r", "__before")


def adjacency_csr(edges: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``indptr(row_idx, start, end)`` and ``entries(row_idx, col_idx, data)``; rows and columns in the order of cell_id."""
    index = cut(dense_index(cells.select("cell_id"), "cell_id").select("cell_id", "row_idx"))
    entries = (
        edges.join(index.select(F.col("cell_id").alias("src"), "row_idx"), "src")
        .join(index.select(F.col("cell_id").alias("dst"), F.col("row_idx").alias("col_idx")), "dst")
        .select("row_idx", "col_idx", F.lit(1.0).alias("data"))
    )
    degree = index.select("row_idx").join(entries.groupBy("row_idx").agg(F.count(F.lit(1)).alias("d")), "row_idx", "left")
    degree = degree.select("row_idx", F.coalesce("d", F.lit(0)).alias("d"))
    block = F.floor(F.col("row_idx") / 100_000)
    blocks = degree.groupBy(block.alias("b")).agg(F.sum("d").alias("n"))
    offset = blocks.select("b", (F.sum("n").over(Window.orderBy("b")) - F.col("n")).alias("offset"))
    running = F.sum("d").over(Window.partitionBy("b").orderBy("row_idx"))
    indptr = degree.withColumn("b", block).withColumn("end", running).join(offset, "b")
    return indptr.select("row_idx", (F.col("offset") + F.col("end") - F.col("d")).alias("start"), (F.col("offset") + F.col("end")).alias("end")), entries
