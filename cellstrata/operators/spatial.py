"""Density, cell-cell interaction and density clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cellstrata.operators.components import connected_components
from cellstrata.operators.graph import _points, khop, near_pairs, radius_graph
from cellstrata.operators.select import effective_class, sample_cells
from cellstrata.plans.lineage import cut, large, small


def kernel_density(
    cells: DataFrame, targets: list[str], bandwidth: float = 50.0, by: str = "detection", annotations: DataFrame | None = None
) -> DataFrame:
    """``(cell_id, density)``: sum of exp(-d^2 / 2h^2) over target cells within 5h, a target counting itself.

    ``by="annotation"`` takes the class of each cell's annotation in place of its own.
    """
    target = effective_class(cells, annotations, by).where(F.col("effective").isin(*targets))
    hits = near_pairs(_points(cells), _points(target), 5 * bandwidth)
    total = hits.groupBy(F.col("a").alias("cell_id")).agg(F.sum(F.exp(-F.col("d2") / (2.0 * bandwidth * bandwidth))).alias("density"))
    return cells.select("cell_id").join(total, "cell_id", "left").select("cell_id", F.coalesce("density", F.lit(0.0)).alias("density"))


def panel_pairs(pairs: DataFrame, expr: DataFrame) -> DataFrame:
    """Pairs ``(ligand, receptor)`` of which both genes are measured."""
    genes = expr.select("gene").distinct()
    out = pairs.select("ligand", "receptor").distinct()
    for side in ("ligand", "receptor"):
        out = out.join(genes.withColumnRenamed("gene", side), side, "left_semi")
    return out


def expression_fraction(expr: DataFrame) -> DataFrame:
    """``(cell_id, gene, p)``: share of the cell's total; NaN is not measured, a total of 0 makes the cell invalid."""
    known = expr.where(~F.isnan("n"))
    total = known.groupBy("cell_id").agg(F.sum("n").alias("total")).where("total > 0")
    return known.join(total, "cell_id").select("cell_id", "gene", (F.col("n") / F.col("total")).alias("p"))


def cell_cell_interaction(
    cells: DataFrame, expr: DataFrame, edges: DataFrame, pairs: DataFrame, k: int = 1, side: str = "ligand", scale: float = 1000.0
) -> DataFrame:
    """``(cell_id, ligand, receptor, score)``: scale * p_c(own gene) * sum of p_d(other gene) over cells d in reach.

    The sum over neighbours is taken once for each gene of the other side, then
    met with the pairs. Valid cells have every pair, at 0 where nothing meets.
    """
    mine, theirs = ("ligand", "receptor") if side == "ligand" else ("receptor", "ligand")
    panel = cut(panel_pairs(pairs, expr))
    p = expression_fraction(expr).join(cells.select("cell_id"), "cell_id", "left_semi")
    valid = p.select("cell_id").distinct()
    reach = edges.select(F.col("src").alias("seed"), F.col("dst").alias("cell_id")) if k == 1 else khop(edges, valid, k).select("seed", "cell_id")
    around = (
        p.join(panel.select(F.col(theirs).alias("gene")).distinct(), "gene", "left_semi")
        .join(reach, "cell_id")
        .groupBy(F.col("seed").alias("cell_id"), F.col("gene").alias(theirs))
        .agg(F.sum("p").alias("s"))
    )
    own = p.withColumnRenamed("gene", mine).join(panel, mine)
    hits = own.join(around, ["cell_id", theirs]).select("cell_id", "ligand", "receptor", (F.lit(scale) * F.col("p") * F.col("s")).alias("score"))
    grid = valid.crossJoin(small(panel))
    return grid.join(hits, ["cell_id", "ligand", "receptor"], "left").select(
        "cell_id", "ligand", "receptor", F.coalesce("score", F.lit(0.0)).alias("score")
    )


def mean_cell_size(measurements: DataFrame, longest: str = "max_diameter", shortest: str = "min_diameter", sample: int = 0, seed: int = 0) -> DataFrame:
    """One row ``size``: the mean of the mean longest and mean shortest diameter, over ``sample`` cells by a seeded hash (0: all)."""
    if sample:
        chosen = sample_cells(measurements.where(F.col("name").isin(longest, shortest)).select("cell_id").distinct(), sample, seed, strict=False)
        measurements = measurements.join(small(cut(chosen.select("cell_id"))), "cell_id", "left_semi")
    mean = lambda n: F.avg(F.when(F.col("name") == n, F.col("value")))
    return measurements.where(F.col("name").isin(longest, shortest)).agg(((mean(longest) + mean(shortest)) / 2).alias("size"))


def dbscan(cells: DataFrame, eps: float, min_pts: int) -> DataFrame:
    """``(cell_id, cluster_id, core)``: the smallest cell_id of the cluster's core cells, null for noise.

    A core cell has ``min_pts`` cells within ``eps``, itself included; a border
    cell belongs to the cluster of smallest id among its core neighbours.
    """
    edges = cut(radius_graph(cells, eps))
    degree = edges.groupBy(F.col("src").alias("cell_id")).agg(F.count(F.lit(1)).alias("d"))
    core = cut(
        cells.select("cell_id").join(large(degree), "cell_id", "left").where(F.coalesce("d", F.lit(0)) + 1 >= min_pts).select("cell_id")
    )
    inner = edges.join(large(core.withColumnRenamed("cell_id", "src")), "src", "left_semi").join(large(core.withColumnRenamed("cell_id", "dst")), "dst", "left_semi")
    comp = connected_components(inner)
    cluster = core.join(large(comp.select(F.col("node").alias("cell_id"), "component")), "cell_id", "left")
    cluster = cluster.select("cell_id", F.coalesce("component", "cell_id").alias("own"))
    border = (
        edges.join(large(cluster.select(F.col("cell_id").alias("dst"), "own")), "dst").groupBy(F.col("src").alias("cell_id")).agg(F.min("own").alias("near"))
    )
    return (
        cells.select("cell_id")
        .join(large(cluster), "cell_id", "left")
        .join(large(border), "cell_id", "left")
        .select("cell_id", F.coalesce("own", "near").alias("cluster_id"), F.col("own").isNotNull().alias("core"))
    )


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """``clusters`` with ``cells_in_image`` and ``cells_in_cluster`` (null for noise)."""
    size = clusters.where("cluster_id is not null").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cells_in_cluster"))
    total = clusters.agg(F.count(F.lit(1)).alias("cells_in_image"))
    return clusters.join(large(size), "cluster_id", "left").crossJoin(F.broadcast(total))


def cluster_position(cells: DataFrame, clusters: DataFrame, edges: DataFrame, angle: float = 140.0) -> DataFrame:
    """``(cell_id, cluster_id, position)``: edge if the widest gap between directions to neighbours of the cluster is ``angle`` degrees or more.

    One neighbour, or none, leaves a gap of 360 degrees. Cells outside clusters are noise.
    """
    at = cells.select("cell_id", "x", "y").join(large(clusters.select("cell_id", "cluster_id")), "cell_id")
    a = at.select(F.col("cell_id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"), "cluster_id")
    b = at.select(F.col("cell_id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"), "cluster_id")
    turn = F.degrees(F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")))
    w = Window.partitionBy("src").orderBy("t")
    first = F.min("t").over(Window.partitionBy("src"))
    gap = edges.join(large(a), "src").join(large(b), ["dst", "cluster_id"]).select("src", turn.alias("t"))
    gap = gap.withColumn("gap", F.coalesce(F.lead("t").over(w), first + 360.0) - F.col("t"))
    widest = gap.groupBy(F.col("src").alias("cell_id")).agg(F.max("gap").alias("gap"))
    position = F.when(F.col("cluster_id").isNull(), "noise").when(F.coalesce("gap", F.lit(360.0)) >= angle, "edge").otherwise("center")
    return clusters.select("cell_id", "cluster_id").join(large(widest), "cell_id", "left").select("cell_id", "cluster_id", position.alias("position"))


def edge_degree(positions: DataFrame, edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """``(cell_id, degree)``: steps inward from the nearest edge cell of the same cluster, 0 on the edge; null out of reach."""
    inside = positions.where("cluster_id is not null").select("cell_id", "cluster_id")
    e = (
        edges.join(large(inside.select(F.col("cell_id").alias("src"), "cluster_id")), "src")
        .join(large(inside.select(F.col("cell_id").alias("dst"), "cluster_id")), ["dst", "cluster_id"])
        .select(F.col("src").alias("cell_id"), "dst")
    )
    e = cut(e)
    frontier = cut(positions.where("position = 'edge'").select("cell_id", F.lit(0).alias("degree")))
    seen, k = frontier, 0
    while not frontier.isEmpty() and k < max_rounds:
        k += 1
        new = e.join(large(frontier), "cell_id").select(F.col("dst").alias("cell_id")).distinct().join(large(seen), "cell_id", "left_anti")
        frontier = cut(new.withColumn("degree", F.lit(k)))
        seen = seen.unionByName(frontier)
    return positions.select("cell_id").join(large(seen), "cell_id", "left")


def encode_position(positions: DataFrame) -> DataFrame:
    p = F.col("position")
    return positions.withColumn("code", F.when(p == "center", 0).when(p == "edge", 1).otherwise(2))
