"""Hand cases and properties."""

import math
import random
import re
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellstrata.functions import quantiles as quantile_module
from cellstrata.functions.quantiles import at_ranks, quantiles
from cellstrata.operators import assign, communities, datasets, enrich, expression, graph, ordered, register, select, spatial, tiles
from cellstrata.operators.components import connected_components
from cellstrata.sources import readers, writers


def path_cells(spark, classes):
    return spark.createDataFrame([(i, float(i), 0.0, c) for i, c in enumerate(classes)], "cell_id long, x double, y double, classification string")


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(8, 30)] + [(50, 50), (None, 3), (60, 61), (61, 60)]
    out = dict(connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert out == {i: 100 for i in range(100, 141)} | {i: 7 for i in range(7, 30)} | {60: 60, 61: 60}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_components_of_a_random_graph(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(160)]
    parent = list(range(300))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert dict(connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()) == {i: root(i) for i in touched}


def test_layers_of_a_path(spark):
    cells = path_cells(spark, ["B", "T", "T", "T", None, "T"])
    edges = graph.radius_graph(cells, 1.0)
    layers = {r.cell_id: r.layer for r in graph.boundary_layers(cells, edges, ["T"]).collect()}
    assert layers == {1: 1, 2: 2, 3: 3}  # the null class is no opponent
    assert {r.cell_id for r in graph.boundary_layers(cells, edges, ["T"], 1).collect()} == {1}


def test_composition_counts_the_neighbourhood(spark):
    cells = path_cells(spark, ["A", "B", "A", None])
    out = graph.neighbourhood_composition(cells, graph.radius_graph(cells, 1.0))
    got = {(r.cell_id, r.classification): (r.n, r.prob) for r in out.collect()}
    assert got[1, "A"] == (2, 1.0) and got[1, "B"] == (1, 0.5) and got[3, "A"] == (1, 1.0) and got[3, "B"] == (0, 0.0)


def test_density_is_additive(spark):
    cells = path_cells(spark, ["A", "B", "A", "B", "C"])
    d = lambda t: dict(spatial.kernel_density(cells, t, 1.0).collect())
    a, b, both = d(["A"]), d(["B"]), d(["A", "B"])
    assert all(math.isclose(a[k] + b[k], both[k]) for k in both) and math.isclose(a[0], 1 + math.exp(-2))


def test_dbscan_against_brute_force(spark):
    r = random.Random(2)
    points = [(i, r.uniform(0, 20), r.uniform(0, 20)) for i in range(150)]
    cells = spark.createDataFrame(points, "cell_id long, x double, y double")
    near = {i: [j for j, u, v in points if (u - x) ** 2 + (v - y) ** 2 <= 2.25] for i, x, y in points}
    core = {i for i in near if len(near[i]) >= 5}
    label = {}
    for i in sorted(core):
        todo = [] if i in label else [i]
        while todo:
            k = todo.pop()
            if k not in label:
                label[k] = i
                todo += [j for j in near[k] if j in core]
    want = {i: label.get(i, min((label[j] for j in near[i] if j in core), default=None)) for i in near}
    assert {r.cell_id: r.cluster_id for r in spatial.dbscan(cells, 1.5, 5).collect()} == want


def test_cluster_position_of_a_cross(spark):
    at = [(0, 0.0, 0.0), (1, 1.0, 0.0), (2, -1.0, 0.0), (3, 0.0, 1.0), (4, 0.0, -1.0)]
    cells = spark.createDataFrame(at, "cell_id long, x double, y double")
    clusters = cells.select("cell_id", F.lit(0).cast("long").alias("cluster_id"))
    out = {r.cell_id: r.position for r in spatial.cluster_position(cells, clusters, graph.radius_graph(cells, 1.0)).collect()}
    assert out == {0: "center", 1: "edge", 2: "edge", 3: "edge", 4: "edge"}


def test_inverse_affine_undoes_affine(spark):
    df = spark.createDataFrame([(1.0, 2.0), (-3.0, 5.5)], "x double, y double")
    m = [2.0, 0.5, 3.0, -0.25, 1.5, 4.0]
    back = register.inverse_affine(register.affine(df, m), [m[:3], m[3:], [0, 0, 1]]).collect()
    assert [(round(r.x, 9), round(r.y, 9)) for r in back] == [(1.0, 2.0), (-3.0, 5.5)]
    with pytest.raises(ValueError):
        register.inverse_affine(df, [[1, 1, 0], [1, 1, 0], [0, 0, 1]])


def test_four_quarter_turns_are_none(spark):
    df = spark.createDataFrame([(3.0, 4.0)], "x double, y double")
    out = df
    for _ in range(4):
        out = register.rotate(out, 90, 10.0, 10.0)
    assert out.collect() == df.collect()
    assert register.rotate(df, "oblique", 10.0, 10.0).collect() == df.collect()


def test_points_in_a_concave_polygon(spark):
    shape = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    objects = spark.createDataFrame([(5, shape), (9, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)])], "object_id long, polygon array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(1, 2.0, 3.0), (2, 0.9, 0.3), (3, 0.5, 2.5), (4, 9.0, 9.0), (5, None, 1.0)], "point_id long, x double, y double")
    out = {r.point_id: r.object_id for r in assign.assign_points(points, objects, 1.5).collect()}
    assert out == {2: 9, 3: 5}


def test_errors_name_what_is_there(spark):
    m = spark.createDataFrame([(1, "area", 2.0)], "cell_id long, name string, value double")
    with pytest.raises(ValueError, match="area"):
        graph.require_measurement(m, "length")
    with pytest.raises(ValueError):
        select.sample_cells(m, 5)


def test_bh_is_monotone_and_not_below_p(spark):
    ps = [0.001, 0.8, 0.01, 0.02, 0.02, 0.5]
    df = spark.createDataFrame([("a", f"g{i}", p) for i, p in enumerate(ps)], "label string, gene string, p double")
    out = sorted((r.p, r.q) for r in expression.bh_adjust(df, "p", "q", ["label"], "gene").collect())
    assert all(q >= p for p, q in out) and all(a[1] <= b[1] for a, b in zip(out, out[1:])) and math.isclose(out[-1][1], 0.8)


def test_layers_by_blocks(spark, monkeypatch):
    """100 layers over several blocks in few rounds; a dense square is dealt out; the limit holds."""
    monkeypatch.setattr(graph, "BLOCK", 400)
    cells = [(100 * x + y, float(x), float(y), "T" if x else "O") for x in range(101) for y in range(6)]
    cells += [(20_000 + k, 50.0, 3.0, "T") for k in range(300)] + [(30_000, None, None, "T"), (2**60 + 1, 7.0, 7.0, None)]
    links = [(a[0], b[0]) for a in cells[:606] for b in cells[:606] if abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1]
    links += [(20_000 + k, 5003) for k in range(300)] + [(30_000, 5003), (2**60 + 1, 700)]
    c = spark.createDataFrame(cells, "cell_id long, x double, y double, classification string")
    e = graph.normalise_edges(spark.createDataFrame(links, "src long, dst long"))
    want = {100 * x + y: x for x in range(1, 101) for y in range(6)} | {20_000 + k: 51 for k in range(300)} | {30_000: 51}
    dealt = graph.spatial_blocks(c, 120).groupBy("block").count().select("count").collect()
    assert sum(r[0] for r in dealt) == len(cells) and max(r[0] for r in dealt) <= 200
    rounds = []
    monkeypatch.setattr(graph, "written", lambda df, name="t", own=graph.written: (rounds.append(name), own(df, name))[1])
    assert {r.cell_id: r.layer for r in graph.boundary_layers(c, e, ["T"]).collect()} == want
    assert rounds.count("layers") < 15
    assert {r.cell_id: r.layer for r in graph.boundary_layers(c, e, ["T"], 4).collect()} == {k: v for k, v in want.items() if v <= 4}


def test_known_communities(spark):
    """Two cliques, a ring of cliques, a planted partition: each group is a community."""
    r = random.Random(1)
    pairs = lambda group: [(a, b) for a in group for b in group if a < b]
    ring = [list(range(6 * c, 6 * c + 6)) for c in range(8)]
    planted = [list(range(24 * c, 24 * c + 24)) for c in range(4)]
    graphs = [
        (ring, [e for g in ring for e in pairs(g)] + [(g[5], ring[(k + 1) % 8][0]) for k, g in enumerate(ring)]),
        (planted, [e for e in pairs(range(96)) if r.random() < (0.6 if e[0] // 24 == e[1] // 24 else 0.03)]),
    ]
    for groups, edges in graphs:
        e = spark.createDataFrame([*edges, (edges[0][1], edges[0][0]), (0, 0)], "src long, dst long")
        state = communities.communities(e).cache()
        if groups is ring:  # by joins alone
            assert sorted(communities.communities(e, one_task=0).collect()) == sorted(state.collect())
        assert {(x.node, x.community) for x in state.collect()} == {(v, min(g)) for g in groups for v in g}
        inside = sum(any({a, b} <= set(g) for g in groups) for a, b in edges)
        want = inside / len(edges) - sum((sum((a in g) + (b in g) for a, b in edges) / 2 / len(edges)) ** 2 for g in groups)
        assert abs(communities.modularity(e, state) - want) < 1e-9
    assert communities.communities(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_size_estimates_of_communities_do_not_grow_from_round_to_round(spark):
    """A product of the sizes of all rounds before fills the driver's memory after some twenty rounds."""
    edges = spark.range(100).selectExpr("id as src", "(id + 1) % 100 as dst", "1D as w")
    edges = edges.union(edges.select("dst", "src", "w"))
    state = spark.range(100).selectExpr("id as node", "2D as k", "id as c")
    for r in range(4):
        state = communities._moved(edges, state.select("node", "k", "c"), 200.0, r)
    assert int(state._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 1 << 64
    parts = communities.refined(edges, state, 200.0)
    assert int(parts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 1 << 64


def test_softmax_and_shift(spark):
    df = spark.createDataFrame([([1.0, 1.0, 3.0],), ([2.0, 2.0, 2.0],)], "scores array<double>")
    assert [r.scores for r in tiles.shift_normalise(df).collect()] == [[0.0, 0.0, 1.0], [0.0, 0.0, 0.0]]
    assert all(math.isclose(sum(r.scores), 1.0) for r in tiles.softmax(df).collect())


def test_stain_matrix_has_unit_columns_and_normalising_to_itself_changes_nothing(spark):
    r = random.Random(4)
    rows = [(i, r.randrange(20, 250), r.randrange(20, 250), r.randrange(20, 250)) for i in range(400)]
    pixels = spark.createDataFrame(rows, "px long, r int, g int, b int")
    m = tiles.stain_matrix(pixels)
    assert all(math.isclose((m[:, k] ** 2).sum(), 1.0) for k in range(3))
    same = tiles.normalise_stain(pixels, m, m).orderBy("px").collect()
    assert all(abs(a.r - b[1]) <= 1 and abs(a.b - b[3]) <= 1 for a, b in zip(same, rows))


def test_stain_matrix_against_arrays(spark):
    r = np.random.default_rng(6)
    rgb = r.integers(20, 250, (5000, 3))
    pixels = spark.createDataFrame([(i, *map(int, x)) for i, x in enumerate(rgb)], "px long, r int, g int, b int")
    od = np.maximum(0, -np.log(np.maximum(rgb, 1e-10) / 255) * 255 / np.log(255)).T
    v = np.linalg.eigh(od @ od.T)[1][:, [2, 1]]
    v = v * np.sign(v[np.abs(v).argmax(0), [0, 1]])
    p = v.T @ od
    p = p[:, np.linalg.norm(p, axis=0) > 16]
    p = p / np.linalg.norm(p, axis=0)
    order = np.argsort((1 - p[1]) * np.sign(p[0]))
    ends = [v @ p[:, order[min(int(s * len(order) + 0.5), len(order) - 1)]] for s in (0.01, 0.99)]
    want = np.stack(sorted(ends, key=lambda x: -x[0]), 1)
    assert np.allclose(tiles.stain_matrix(pixels)[:, :2], want, atol=1e-6)


def test_quantiles_are_those_of_the_sorted_values(spark):
    r = random.Random(8)
    values = [r.gauss(0, 1) ** 5 for _ in range(9000)] + [0.25] * 4000 + [1e300, -1e300]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    want = np.quantile(values, [0, 0.01, 0.5, 0.613, 0.99, 1])
    assert np.allclose(quantiles(df, "v", [0, 0.01, 0.5, 0.613, 0.99, 1]), want, rtol=1e-12)
    assert quantiles(df.where("v is null"), "v", [0.5]) == [None]


def test_quantiles_of_odd_values(spark, monkeypatch):
    """Infinities are values, NaN are not; few values come to the driver; narrow brackets by several passes."""
    df = spark.range(20_000).select((F.xxhash64("id") % 1_000_000).cast("double").alias("v"))
    odd = df.union(spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (None,)], "v double"))
    values = np.sort(np.array([r.v for r in df.collect()] + [np.inf, -np.inf]))
    collected = []
    frame = type(df)
    monkeypatch.setattr(frame, "collect", lambda self, own=frame.collect: (lambda rows: (collected.append(len(rows)), rows)[1])(own(self)))
    shares = [0, 0.1, 0.5, 0.77, 1]
    want = [values[0], values[-1]]
    got = quantiles(odd, "v", shares)
    assert [got[0], got[-1]] == want and np.allclose(got[1:-1], [np.interp(s * (len(values) - 1), np.arange(1, len(values) - 1), values[1:-1]) for s in shares[1:-1]], rtol=1e-12)
    ranks = [0, 1, 7, 9_999, 10_000, 20_001]
    assert at_ranks(odd, "v", ranks) == [values[r] for r in ranks]
    assert max(collected) < 5000
    monkeypatch.setattr(quantile_module, "_FEW", 20)
    monkeypatch.setattr(quantile_module, "_ACCURACY", 100)
    assert at_ranks(odd, "v", ranks) == [values[r] for r in ranks]
    same = spark.range(30_000).select((F.col("id") % 3).cast("double").alias("v"))
    assert quantiles(same, "v", [0.2, 0.5, 0.9]) == [0.0, 1.0, 2.0]


def test_normal_tails(spark):
    zs = [0.0, 0.3, -1.5, 2.9, 3.0, 3.1, -5.0, 8.0, 20.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    got = [x.p for x in df.select(expression.two_sided(F.col("z")).alias("p")).collect()]
    assert all(math.isclose(p, math.erfc(abs(z) / math.sqrt(2)), rel_tol=1e-9) for p, z in zip(got, zs))


def test_components_are_those_of_the_centred_matrix(spark):
    r = np.random.default_rng(2)
    x = np.round(r.gamma(2, 1, (40, 6)), 3)
    df = spark.createDataFrame([(i, f"g{j}", float(x[i, j])) for i in range(40) for j in range(6)], "cell_id long, gene string, n double")
    got = np.array([y.pc for y in expression.pca(df, 3).orderBy("cell_id").collect()])
    c = x - x.mean(0)
    want = c @ np.linalg.svd(c)[2][:3].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)


def test_components_of_sparse_counts(spark):
    """More genes than directions: rounds until the first three are kept; cells without counts are points too."""
    r = np.random.default_rng(6)
    x = r.poisson(0.15, (70, 140)) * 1.0
    x += np.outer(r.integers(0, 2, 70), r.integers(0, 2, 140)) * r.poisson(1.5, (70, 140)) + np.outer(np.arange(70) % 3 == 0, np.arange(140) % 4 == 0) * 2
    x[9] = 0
    rows = [(int(i), f"g{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x))] + [(9, "g0", 0.0), (9, "other", 5.0)]
    df = spark.createDataFrame(rows, "cell_id long, gene string, n double")
    panel = spark.createDataFrame([(f"g{j}",) for j in range(140)], "gene string")
    got = np.array([y.pc for y in expression.pca(df, 3, panel, more=6).orderBy("cell_id").collect()])
    c = x - x.mean(0)
    want = c @ np.linalg.svd(c)[2][:3].T
    assert got.shape == (70, 3) and np.allclose(np.abs(got), np.abs(want), atol=1e-5)
    assert expression.pca(df.limit(0), 3).count() == 0
    assert [y.pc for y in expression.pca(df.where("n = 0"), 2).collect()] == [[]]


def test_counts_are_prepared_from_one_reading(spark):
    """As the operators one after the other, from counts that are made once."""
    r = np.random.default_rng(3)
    counts = [(c, f"g{g}", float(r.integers(0, 9))) for c in range(120) for g in range(40) if r.random() < (0.02 if c % 11 == 0 or g == 5 else 0.3)]
    made = spark.sparkContext.accumulator(0)

    def seen(frames):
        for f in frames:
            made.add(len(f))
            yield f

    expr = spark.createDataFrame(counts + [(None, "g1", 50.0), (3, None, 9.0), (200, "g1", 90.0)], "cell_id long, gene string, n double")
    got = {(x.cell_id, x.gene): x.n for x in enrich._prepared(expr.mapInPandas(seen, expr.schema)).collect()}
    assert made.value == len(counts) + 3
    e = expression.filter_genes(expression.filter_cells(expr))
    want = expression.log_counts(expression.normalise_total(expression.trim_by_genes(e)))
    assert got == {(x.cell_id, x.gene): x.n for x in want.collect()} and len({c for c, _ in got}) > 60


def test_tar_shards(spark, tmp_path):
    images = spark.createDataFrame([(str(i), bytes([i] * i)) for i in range(25)], "key string, content binary").repartition(2)
    labels = spark.createDataFrame([(str(i), f"c{i % 3}") for i in range(24)], "key string, label string")
    found = {}
    for row in writers.write_tile_shards(images, labels, str(tmp_path / "t"), 5).collect():
        with tarfile.open(row.file) as f:
            names = f.getnames()
            assert len(names) == 2 * row.tiles <= 10
            found |= {n: f.extractfile(n).read() for n in names}
    assert found == {f"{i}.png": bytes([i] * i) for i in range(24)} | {f"{i}.cls": f"c{i % 3}".encode() for i in range(24)}


@pytest.fixture
def no_coalescing(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_tiles_of_one_partition_are_dealt_to_tasks(spark, tmp_path, no_coalescing):
    images = spark.createDataFrame([(str(i), bytes([i])) for i in range(80)], "key string, content binary").coalesce(1)
    labels = spark.createDataFrame([(str(i), "c") for i in range(80)], "key string, label string").coalesce(1)
    shards = writers.write_tile_shards(images, labels, str(tmp_path / "t"), 100).collect()
    assert len(shards) == 4 and sum(s.tiles for s in shards) == 80
    writers.write_tile_dataset(images, labels, str(tmp_path / "d"), 100)
    assert len(list((tmp_path / "d").glob("*.parquet"))) == 4


def test_split_keeps_keys_on_one_side_and_sample_has_its_size(spark):
    rows = spark.createDataFrame([(str(i % 500), i) for i in range(1000)], "key string, n long")
    out = datasets.train_validation_split(rows, 0.8)
    assert out.groupBy("key").agg(F.count_distinct("part").alias("k")).where("k > 1").count() == 0
    assert 0.7 < out.where("part = 'train'").count() / 1000 < 0.9
    cells = spark.range(300).withColumnRenamed("id", "cell_id")
    some = [x.cell_id for x in select.sample_cells(cells, 50, 3).collect()]
    assert len(set(some)) == 50 and sorted(some) == sorted(x.cell_id for x in select.sample_cells(cells.repartition(7), 50, 3).collect())
    m = spark.createDataFrame([(i, n, float(i)) for i in range(100) for n in ("max_diameter", "min_diameter")], "cell_id long, name string, value double")
    assert spatial.mean_cell_size(m).first().size == 49.5 == spatial.mean_cell_size(m, sample=100).first().size
    assert 0 <= spatial.mean_cell_size(m, sample=10).first().size <= 99


def test_balance_draws_n_of_each_class(spark):
    rows = spark.createDataFrame([(str(i), "a" if i % 3 else "b") for i in range(30)], "key string, classification string")
    assert dict(datasets.class_counts(datasets.balance_classes(rows, 12)).collect()) == {"a": 12, "b": 12}


def test_ranks_of_one_gene_span_tasks(spark):
    """Totals before each row of a key that holds all rows; partitions stay even."""
    df = spark.range(20_000).select(F.lit("g").alias("gene"), (F.xxhash64("id") % 100_003).cast("double").alias("v"), (F.col("id") % 3 + 1).alias("c"))
    df = df.groupBy("gene", "v").agg(F.sum("c").alias("c")).union(spark.createDataFrame([("h", 1.0, 5), ("h", 2.0, 7)], "gene string, v double, c long"))
    out = ordered.running_totals(df, ["gene"], ["v"], "c", "below")
    total = {"g": 0, "h": 0}
    for r in out.orderBy("gene", "v").collect():
        assert r.below == total[r.gene]
        total[r.gene] += r.c
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r[0] for r in df.repartitionByRange("gene", "v").groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert len(sizes) == 4 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ordered.running_totals(df.limit(0), ["gene"], ["v"], "c", "below").count() == 0


def test_lines_are_numbered_in_file_order(spark, tmp_path):
    """Blocks of a file, several files of any size, no Python in the plan."""
    lines = [f"line {k} " + "x" * (k % 70) for k in range(3000)]
    (tmp_path / "a.txt").write_text("\n".join(lines[:200]) + "\n")
    (tmp_path / "b.txt").write_text("\n".join(lines[200:2900]))
    (tmp_path / "c.txt").write_text("\n".join(lines[2900:]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000b")
    try:
        out = readers.numbered_lines(spark, str(tmp_path))
        assert out.rdd.getNumPartitions() > 10
        assert [r.value for r in out.orderBy("i").collect()] == lines and out.agg(F.min("i"), F.max("i")).first() == (0, 2999)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert not any(x in out._jdf.queryExecution().toString() for x in ("Python", "Arrow", "ExternalRDD"))


def test_neighbours_of_clusters(spark, monkeypatch):
    """Exact with hot cells and equal vectors; clustered vectors meet few cells, so asks grow less than eightfold for four times the rows."""
    r = np.random.default_rng(12)
    centres = r.normal(0, 40, (40, 6))
    asked = []
    monkeypatch.setattr(expression, "written", lambda df, name="t", own=expression.written: (lambda out: (asked.append(out.count()) if name == "asks" else None, out)[1])(own(df, name)))
    for n in (400, 1600):
        x = centres[r.integers(0, 40, n)] + r.normal(0, 1, (n, 6))
        x[: n // 3] = x[0] + r.normal(0, 0.01, (n // 3, 6))  # a hot cell
        x[5:9] = x[4]
        df = spark.createDataFrame([(i, [float(a) for a in v], "mine") for i, v in enumerate(x)], "id long, v array<double>, cell string")
        got: dict = {}
        for y in expression.neighbours(df, 4, block=50).collect():
            got.setdefault(y.id, []).append(y.distance)
        d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
        np.fill_diagonal(d, np.inf)
        assert sorted(got) == list(range(n)) and np.allclose([sorted(got[i]) for i in range(n)], np.sort(d, 1)[:, :4], atol=1e-5)
    assert asked[1] < 8 * asked[0]
    assert len(expression.neighbours(df.limit(3), 5).collect()) == 6 and expression.neighbours(df.limit(0), 5).count() == 0


def test_neighbours_are_written_once(spark, monkeypatch):
    """Vectors without clusters meet nearly all blocks, yet no table that is written holds them more than once; of equal distances the smaller id."""
    r = np.random.default_rng(4)
    sizes = []
    monkeypatch.setattr(expression, "written", lambda df, name="t", own=expression.written: (lambda out: (sizes.append(out.count()), out)[1])(own(df, name)))
    x = r.normal(0, 1, (900, 8)) * 1000
    x[100:140] = x[7]
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<double>")
    got: dict = {}
    for y in expression.neighbours(df, 3, block=50).collect():
        got.setdefault(y.id, []).append((y.distance, y.other))
    assert max(sizes[:-1]) <= 900 and sizes[-1] <= 900 * 3 * 8
    for i in range(900):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        order = np.lexsort((np.arange(900), d))[:3]
        assert [o for _, o in sorted(got[i])] == order.tolist()
    assert sorted(got[139]) == [(0.0, 7), (0.0, 100), (0.0, 101)]


def test_tissue_tile_at_the_threshold(spark):
    """A mean that is the threshold in exact numbers is not below it, though the thirds of its pixels add up to less."""
    assert (498 / 3.0 + 497 / 3.0 + 157 / 3.0) / 3 < 128
    rows = [(0, i, s // 3, s // 3, s - 2 * (s // 3)) for i, s in enumerate((498, 497, 157))] + [(16, 0, 1, 2, 3)]
    found = tiles.tissue_tiles(spark.createDataFrame(rows, "px long, py int, r int, g int, b int").coalesce(1), 128.0).collect()
    assert [(r.gx, r["mean"]) for r in found] == [(1, 2.0)]


def test_near_pairs_hold_no_table_of_all_points(spark):
    """Points are dealt before each is made nine, and neither side is broadcast however small its files look."""
    df = spark.createDataFrame([(i, float(i % 30), float(i // 30)) for i in range(900)], "id long, x double, y double")
    near = graph.near_pairs(df, df, 1.5).where("a <> b")
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert "Exchange" in plan[plan.rindex("Generate") :]  # below the squares around each point
    at = {(r.a, r.b) for r in near.collect()}
    assert at == {(i, j) for i in range(900) for j in range(900) if i != j and (i % 30 - j % 30) ** 2 + (i // 30 - j // 30) ** 2 <= 2.25}


@pytest.fixture
def slide(spark, tmp_path):
    """``(cells, edges)`` of a slide whose file is far smaller than what may be broadcast."""
    rows = [(i, float(i % 30) + 0.01 * (i % 7), float(i // 30), "Tumor" if 6 < i % 30 < 24 else "B", i % 3) for i in range(900) if i % 11]
    spark.createDataFrame(rows, "cell_id long, x double, y double, classification string, annotation_id int").write.parquet(f"{tmp_path}/cells")
    cells = spark.read.parquet(f"{tmp_path}/cells")
    return cells, graph.radius_graph(cells, 1.5)


def test_sums_in_another_order_leave_genes_in_their_bins(spark):
    """As on a cluster, the last digits of a sum are others each time it is made."""
    last = F.udf(lambda x: x * (1 + 1e-13 * random.SystemRandom().uniform(-1, 1)), "double").asNondeterministic()
    rows = [(c, g, x * (1 + c % k)) for g, x, k in (("a", 1.0, 3), ("b", 1.01, 4), ("c", 9.0, 3), ("d", 30.0, 5)) for c in range(24)]
    expr = spark.createDataFrame(rows, "cell_id long, gene string, n double").withColumn("n", last(F.log1p("n")))
    for _ in range(6):
        z = {r.gene: round(r.z, 3) for r in expression.highly_variable_genes(expr, 24, bins=10).collect()}
        assert z == {"a": -0.707, "b": 0.707, "c": 1.0, "d": 1.0}


def hashed_keys(spark, run):
    """Left keys of the broadcast hash joins in all plans of the frames that ``run`` executes; none is made for sizes seen at run time."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty(30_000)
    before = store.executionsCount()
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        run().collect()
        bus.waitUntilEmpty(30_000)
        done = store.executionsList(before, store.executionsCount() - before)
        plans = [done.apply(k).physicalPlanDescription() for k in range(done.size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert any("SortMergeJoin" in p for p in plans)
    return {key for p in plans for keys in re.findall(r"BroadcastHashJoin.*\nLeft keys \[\d+\]: \[(.*)\]", p) for key in re.findall(r"(\w+)#", keys)}


def test_steps_of_the_graph_hold_no_table_of_all_cells(spark, slide):
    cells, edges = slide
    assert not hashed_keys(spark, lambda: graph.khop(edges, cells.select("cell_id"), 2))
    assert not hashed_keys(spark, lambda: graph.neighbourhood_enrichment(cells, edges, ["Tumor"], k=1))
    assert hashed_keys(spark, lambda: graph.neighbourhood_composition(cells, edges)) <= {"classification"}


def test_layers_hold_no_table_of_all_cells(spark, slide):
    """Only the names of active blocks and the counts of grid squares are broadcast."""
    cells, edges = slide
    layers = lambda: graph.boundary_layers(cells, edges, ["Tumor"])
    assert hashed_keys(spark, layers) <= {"block", "bx", "by"}
    assert hashed_keys(spark, lambda: graph.layer_summary(layers(), cells.select("cell_id"))) <= {"block", "bx", "by"}
    m = cells.selectExpr("cell_id", "'total' as name", "x as value")
    assert hashed_keys(spark, lambda: graph.boundary_layers_by_measurement(cells, m, edges, "total", ">", 9.0)) <= {"block", "bx", "by"}


def test_clusters_hold_no_table_of_all_cells(spark, slide):
    """Keys ``u`` are those of components, whose edges are estimated as a product of sizes, small on this slide only."""
    cells, edges = slide
    clusters = lambda: spatial.dbscan(cells, 1.5, 8)
    assert hashed_keys(spark, lambda: spatial.cluster_sizes(clusters())) <= {"u"}
    assert hashed_keys(spark, lambda: spatial.cluster_position(cells, clusters(), edges)) <= {"u"}
    few = cells.selectExpr("cell_id", "cell_id % 5 as cluster_id")
    assert not hashed_keys(spark, lambda: spatial.cluster_sizes(few)) and not hashed_keys(spark, lambda: spatial.cluster_position(cells, few, edges))


def test_degrees_hold_no_table_of_all_cells(spark, slide):
    cells, edges = slide
    positions = cells.selectExpr("cell_id", "1L as cluster_id", "case when x < 1 then 'edge' else 'center' end as position")
    assert not hashed_keys(spark, lambda: spatial.edge_degree(positions, edges))
