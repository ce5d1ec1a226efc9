"""Term enrichment and reverse scoring.

``gene_map(symbol, gene_id)``, ``assoc(gene_id, go_id, ns)``, ``terms(go_id, name, ns)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from cellstrata.operators import expression as ex
from cellstrata.operators.select import split_target_opponent
from cellstrata.plans.lineage import cut, small, written


def map_symbols(genes: DataFrame, gene_map: DataFrame) -> DataFrame:
    """``genes(symbol)`` that have an id; the others are dropped."""
    return genes.join(gene_map.select("symbol", "gene_id"), "symbol")


def select_namespaces(assoc: DataFrame, bp: bool = True, mf: bool = True, cc: bool = True) -> DataFrame:
    names = [n for n, on in (("BP", bp), ("MF", mf), ("CC", cc)) if on]
    if not names:
        raise ValueError("at least one namespace is needed")
    return assoc.where(F.col("ns").isin(*names))


def log_factorials(spark, n: int) -> DataFrame:
    """``(k, lf)`` for k = 0 to n: sums of logarithms within blocks, and of the blocks before."""
    size = 10_000
    steps = spark.range(0, n + 1).select(F.col("id").alias("k"), F.when(F.col("id") > 1, F.log(F.col("id").cast("double"))).otherwise(0.0).alias("l"))
    steps = steps.withColumn("b", F.floor(F.col("k") / size))
    blocks = steps.groupBy("b").agg(F.sum("l").alias("s"))
    before = blocks.select("b", (F.sum("s").over(Window.orderBy("b")) - F.col("s")).alias("before"))
    run = F.sum("l").over(Window.partitionBy("b").orderBy("k"))
    return steps.withColumn("run", run).join(F.broadcast(before), "b").select("k", (F.col("run") + F.col("before")).alias("lf"))


def go_enrichment(study: DataFrame, population: DataFrame, assoc: DataFrame, terms: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """A row per namespace and term that the study ``(gene_id)`` has: Fisher's exact test against the population ``(gene_id)``.

    Columns ``ns, go_id, n_genes, n_study, n_go, n_pop, p, q, direction,
    study_genes, per`` (and ``name`` from ``terms``). Two-sided: the sum of
    all outcomes not more likely than what was seen (within 1e-7). With ``by``
    the study has these columns too and each of their values is a study of its
    own; q is adjusted within each. Equal margins are computed once.
    """
    by = list(by)
    s = study.select(*by, "gene_id").distinct()
    pop = population.select("gene_id").distinct()
    a = assoc.select("gene_id", "go_id", "ns").distinct().join(pop, "gene_id", "left_semi")
    counts = a.join(s, "gene_id").groupBy(*by, "ns", "go_id").agg(F.count(F.lit(1)).alias("n_genes"), F.array_sort(F.collect_set("gene_id")).alias("study_genes"))
    counts = counts.join(a.groupBy("ns", "go_id").agg(F.count(F.lit(1)).alias("n_go")), ["ns", "go_id"])
    n_study = s.join(pop, "gene_id", "left_semi").groupBy(*by).agg(F.count(F.lit(1)).alias("n_study"))
    counts = counts.join(small(cut(n_study)), by) if by else counts.crossJoin(F.broadcast(n_study))
    t = cut(counts.crossJoin(F.broadcast(pop.agg(F.count(F.lit(1)).alias("n_pop")))))
    margins = ["n_genes", "n_go", "n_study", "n_pop"]
    size = t.agg(F.max("n_pop")).first()[0] or 0
    lf = cut(log_factorials(t.sparkSession, size))
    k = F.sequence(F.greatest(F.lit(0), F.expr("n_go + n_study - n_pop")), F.least("n_go", "n_study"))
    cells = t.select(*margins).distinct().select(*margins, F.explode(k).alias("k"))
    # ln pmf(k) = ln C(n_go, k) + ln C(n_pop - n_go, n_study - k) - ln C(n_pop, n_study)
    parts = {
        "a": "n_go", "b": "k", "c": "n_go - k", "d": "n_pop - n_go", "e": "n_study - k",
        "f": "n_pop - n_go - n_study + k", "g": "n_pop", "h": "n_study", "i": "n_pop - n_study",
    }
    for name, at in parts.items():
        table = F.broadcast(lf) if size <= 1_000_000 else lf
        cells = cells.withColumn("at", F.expr(at).cast("long")).join(table.select(F.col("k").alias("at"), F.col("lf").alias(name)), "at").drop("at")
    cells = cells.withColumn("ln", F.expr("(a - b - c) + (d - e - f) - (g - h - i)"))
    seen = F.max(F.when(F.col("k") == F.col("n_genes"), F.col("ln"))).over(Window.partitionBy(*margins))
    p = cells.withColumn("seen", seen).where("ln <= seen + 1e-7").groupBy(*margins).agg(F.least(F.lit(1.0), F.sum(F.exp("ln"))).alias("p"))
    direction = F.when(F.expr("n_genes * n_pop >= n_study * n_go"), "enriched").otherwise("depleted")
    out = t.join(p, margins).withColumn("direction", direction).withColumn("per", F.col("n_genes") / F.col("n_go"))
    out = ex.bh_adjust(out, "p", "q", [*by, "ns"], "go_id")
    return out if terms is None else out.join(terms.select("go_id", "ns", "name").dropDuplicates(["go_id", "ns"]), ["go_id", "ns"], "left")


def significant_terms(result: DataFrame, q: float = 0.05) -> DataFrame:
    return result.where((F.col("q") < q) & (F.col("n_genes") > 1))


def top_terms(result: DataFrame, n: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` by p, of each ``by``."""
    if not by:
        return result.orderBy("p", "go_id").limit(n)
    w = Window.partitionBy(*by).orderBy("p", "go_id")
    return result.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def curate_terms(result: DataFrame) -> DataFrame:
    """Over all clusters, each term at its smallest p."""
    w = Window.partitionBy("go_id").orderBy("p", "cluster")
    return result.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r").orderBy("q", "go_id")


def term_text(result: DataFrame) -> DataFrame:
    """One row ``text``: a cluster's terms joined by commas, clusters by a blank line; null without any."""
    lines = result.groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "go_id"))), lambda x: x["go_id"]), ", ").alias("line"))
    joined = F.transform(F.sort_array(F.collect_list(F.struct("cluster", "line"))), lambda x: x["line"])
    return lines.agg(F.when(F.count(F.lit(1)) > 0, F.array_join(joined, "\n\n")).alias("text"))


def gene_weights(terms: DataFrame, assoc: DataFrame, gene_map: DataFrame, measured: DataFrame) -> DataFrame:
    """``(gene, weight)``: matches of ``terms(go_id)`` among the measured genes ``(gene)``, by namespace and term."""
    hit = assoc.select("gene_id", "go_id", "ns").distinct().join(terms.select("go_id").distinct(), "go_id", "left_semi")
    named = hit.join(gene_map, "gene_id").select(F.col("symbol").alias("gene"))
    return named.join(measured.select("gene").distinct(), "gene", "left_semi").groupBy("gene").agg(F.count(F.lit(1)).alias("weight"))


def score_cells(expr: DataFrame, weights: DataFrame, top: int, scale: float = 1e5) -> DataFrame:
    """``(cell_id, score)``: weights of the cell's ``top`` genes summed, the minimum subtracted, as a share of the total times ``scale``."""
    w = Window.partitionBy("cell_id").orderBy(F.desc("n"), "gene")
    first = expr.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    raw = first.join(weights, "gene", "left").groupBy("cell_id").agg(F.sum(F.coalesce("weight", F.lit(0))).alias("raw"))
    ends = raw.agg(F.min("raw").alias("low"), F.sum("raw").alias("sum"), F.count(F.lit(1)).alias("cells"))
    total = F.col("sum") - F.col("low") * F.col("cells")
    return raw.crossJoin(F.broadcast(ends)).select(
        "cell_id", F.when(total > 0, (F.col("raw") - F.col("low")) / total * scale).otherwise(0.0).alias("score")
    )


def _prepared(expr: DataFrame) -> DataFrame:
    """Filtered, trimmed, normalised log counts, as the operators of ``expression`` one after the other give them.

    Counts are written before each is read twice, genes to keep are broadcast,
    and what trimming and scaling ask of a cell meets the counts in one join.
    """
    e = written(expr.select("cell_id", "gene", "n"), "counts")
    e = written(ex.filter_cells(e), "counts")
    e = e.join(small(cut(ex.genes_in_cells(e))), "gene", "left_semi")
    cell = written(e.groupBy("cell_id").agg(F.count_if(F.col("n") > 0).alias("g"), F.sum("n").alias("total")).where("g > 0"), "cells")
    cell = cut(ex.between_quantiles(cell, "g").where("total > 0"))
    return written(ex.log_counts(ex.scaled(e, cell)), "prepared")


def _terms_of(genes: DataFrame, population: DataFrame, gene_map: DataFrame, assoc: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    symbols = genes.select(*by, F.col("gene").alias("symbol")).distinct()
    measured = population.select(F.col("gene").alias("symbol")).distinct()
    return significant_terms(go_enrichment(map_symbols(symbols, gene_map), map_symbols(measured, gene_map), assoc, by=by))


def forward_high(expr: DataFrame, gene_map: DataFrame, assoc: DataFrame, genes: int = 100, terms: int = 10) -> DataFrame:
    """Terms of the genes of highest mean."""
    e = _prepared(expr)
    return top_terms(_terms_of(ex.top_genes_by_mean(e, genes), e, gene_map, assoc), terms)


def forward_comparative(cells: DataFrame, expr: DataFrame, targets: Sequence[str], gene_map: DataFrame, assoc: DataFrame, genes: int = 100, terms: int = 10) -> DataFrame:
    """Terms of the genes that set targets apart from all other classes."""
    e = _prepared(expr)
    labels = split_target_opponent(cells, targets).withColumn("label", F.col("label").cast("string"))
    ranked = ex.rank_genes(e, labels.join(e.select("cell_id").distinct(), "cell_id", "left_semi"))
    return top_terms(_terms_of(ex.comparative_markers(ranked, "1", genes), e, gene_map, assoc), terms)


def forward_differential(expr: DataFrame, labels: DataFrame, gene_map: DataFrame, assoc: DataFrame, genes: int = 100, terms: int = 10, padj: float = 0.05, lfc: float = 1.5) -> DataFrame:
    """For every cluster of ``labels(cell_id, label)`` the terms of its markers: ``cluster`` and the columns of ``go_enrichment``.

    One plan tests all clusters.
    """
    e = _prepared(expr)
    ranked = ex.rank_genes(e, labels.join(e.select("cell_id").distinct(), "cell_id", "left_semi"))
    markers = ex.cluster_markers(ranked, genes, padj, lfc).select(F.col("label").alias("cluster"), "gene")
    return curate_terms(top_terms(_terms_of(markers, e, gene_map, assoc, ["cluster"]), terms, ["cluster"]))


def reverse_score(expr: DataFrame, terms: DataFrame, assoc: DataFrame, gene_map: DataFrame, top: int = 100) -> DataFrame:
    """Cells scored by how many matches of the given terms their highest genes have."""
    return score_cells(expr, gene_weights(terms, assoc, gene_map, expr), top)
