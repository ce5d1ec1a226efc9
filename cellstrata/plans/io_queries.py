"""Round trips: files that Spark writes from the given tables, read by the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from cellstrata.functions.geometry import box_polygon
from cellstrata.operators import select
from cellstrata.operators.graph import dense_index
from cellstrata.plans.fixtures import Tables
from cellstrata.plans.lineage import cut, distinct_names, shared_dir
from cellstrata.plans.queries import query
from cellstrata.sources import readers, writers


def _folder(t: Tables) -> str:
    return f"{shared_dir(t.spark)}/io-{uuid.uuid4().hex}"


def _saved(t: Tables, df: DataFrame, sep: str = ",", header: bool = True, **options: str) -> str:
    path = _folder(t)
    df.write.csv(path, header=header, sep=sep, **options)
    return path


@query("s1_xenium_cells", "select cast(cell_id as varchar) as cell_id, x, y from {cells}")
def _(t):
    rest = [F.lit(1.0).alias(f"c{i}") for i in range(6)]
    path = _saved(t, t("cells").select(F.col("cell_id").cast("string"), "x", "y", *rest), compression="gzip")
    return readers.read_xenium_cells(t.spark, path).select("cell_id", "x", "y")


@query("s2_clusters", "select cast(cell_id as varchar) as cell_id, annotation_id as label from {cells} where classification is not null")
def _(t):
    label = F.when(F.col("classification").isNotNull(), F.col("annotation_id").cast("string")).otherwise("none")
    return readers.read_clusters(t.spark, _saved(t, t("cells").select(F.col("cell_id").cast("string"), label), quoteAll="true"))


@query("s3_mtx", "select cast(cell_id as varchar) as cell_id, gene, cast(n as bigint) as n from {expr}")
def _(t):
    cells = cut(dense_index(t("expr").select("cell_id").distinct(), "cell_id"))
    genes = cut(dense_index(t("expr").select("gene").distinct(), "gene", "col_idx"))
    barcodes, features, matrix = (_folder(t) for _ in range(3))
    cells.orderBy("row_idx").select(F.col("cell_id").cast("string")).write.text(barcodes)
    genes.orderBy("col_idx").select(F.concat_ws("\t", "gene", "gene", F.lit("Gene Expression"))).write.text(features)
    triples = t("expr").join(cells, "cell_id").join(genes, "gene").select(F.lit(3).alias("o"), F.concat_ws(" ", F.col("col_idx") + 1, F.col("row_idx") + 1, F.col("n").cast("long")).alias("v"))
    head = t.spark.createDataFrame([(0, "%%MatrixMarket matrix coordinate integer general"), (1, "%"), (2, "0 0 0")], "o int, v string")
    lines = head.union(triples).withColumn("h", F.xxhash64("v"))  # three lines first, the others dealt over all partitions
    lines.repartitionByRange("o", "h").sortWithinPartitions("o", "h").select("v").write.text(matrix)
    return readers.read_mtx(t.spark, barcodes, features, matrix).select("cell_id", "gene", "n")


@query("s4_visium_positions", "select concat('b', point_id) as barcode, 1 as in_tissue, cast(x as int) as x, cast(y as int) as y from {points}")
def _(t):
    at = [F.col(c).cast("int") for c in "yxyx"]
    path = _saved(t, t("points").select(F.concat(F.lit("b"), "point_id"), F.lit(1), *at), header=False)
    return readers.read_visium_positions(t.spark, path, headered=False).select("barcode", "in_tissue", "x", "y")


def _wide(t: Tables, key: list) -> DataFrame:
    genes = distinct_names(t("expr"), "gene")
    return t("expr").groupBy(*key).pivot("gene", genes).agg(F.sum("n")).na.fill(0)


@query("s5_cosmx", "select annotation_id as fov, cast(cell_id as int) as cell_id, x, y, gene, n from {cells} join {expr} using (cell_id)")
def _(t):
    cells = t("cells").select(F.col("annotation_id").alias("fov"), "cell_id", *[F.lit("").alias(f"c{i}") for i in range(2, 6)], "x", "y")
    fovs = cells.groupBy("fov").agg(F.min("x"), F.min("y"))
    wide = cells.select("fov", "cell_id").join(_wide(t, ["cell_id"]), "cell_id").select("fov", "cell_id", *[c for c in _wide(t, ["cell_id"]).columns if c != "cell_id"])
    _, c, e = readers.read_cosmx(t.spark, _saved(t, fovs), _saved(t, cells), _saved(t, wide))
    return c.join(e, ["fov", "cell_id"])


@query("s6_st_matrix", "select x, y, gene, sum(n) as n from {cells} join {expr} using (cell_id) group by x, y, gene")
def _(t):
    at = t("cells").select("cell_id", F.concat_ws("x", "x", "y").alias("at"))
    wide = at.join(_wide(t, ["cell_id"]), "cell_id").drop("cell_id")
    wide = wide.groupBy("at").agg(*[F.sum(f"`{c}`").alias(c) for c in wide.columns if c != "at"])
    return readers.read_st_matrix(t.spark, _saved(t, wide, "\t"))


@query("s7_predictions", "select cast(cell_id as varchar) as cell_id, classification, x as x_um, y as y_um from {cells}")
def _(t):
    blank = [F.lit("-").alias(f"b{i}") for i in range(5)]
    rows = t("cells").select(blank[0], F.col("cell_id").cast("string"), blank[1], blank[2], "classification", blank[3], blank[4], "x", "y")
    return readers.read_predictions(t.spark, _saved(t, rows, "\t"))


@query("s8_lr_pairs", "select ligand, receptor from {lr_pairs}")
def _(t):
    rows = t("lr_pairs").select(F.lit("1").alias("id"), "ligand", "receptor")
    return readers.read_lr_pairs(t.spark, _saved(t, rows, quoteAll="true"))


@query("s9_go", "select symbol, go_id, ns from {go_assoc} join {gene_map} using (gene_id)")
def _(t):
    assoc = t("go_assoc").select(F.lit(9606).alias("taxon"), "gene_id", "go_id", "ns")
    terms = t("go_assoc").select("go_id", F.col("go_id").alias("name"), "ns").distinct()
    g, a, _ = readers.read_go(t.spark, *[_saved(t, df, "\t") for df in (t("gene_map"), assoc.union(assoc.withColumn("taxon", F.lit(10090))), terms)])
    return a.join(g, "gene_id").select("symbol", "go_id", "ns")


@query("s10_object_tables", "select cast(cell_id as varchar) as object_id, classification from {cells}")
def _(t):
    rows = t("cells").select(F.col("cell_id").cast("string").alias("Object ID"), F.col("classification").alias("Classification"))
    out = readers.read_object_tables(t.spark, _saved(t, rows, "\t"))
    return out.select(F.substring_index("key", "/", -1).alias("object_id"), "classification")


@query("s11_tile_images", "select 'txt' as extension, sum(octet_length(encode(html)) + 1)::bigint as bytes from {pages} where html is not null")
def _(t):
    path = _folder(t)
    t("pages").select("html").where("html is not null").write.text(path, lineSep="\u0001")
    return readers.read_tile_images(t.spark, path, "*.txt").groupBy("extension").agg(F.sum(F.octet_length("content")).alias("bytes"))


def _objects(t: Tables) -> DataFrame:
    c = t("boxes").join(t("cells").select(F.col("cell_id").alias("object_id"), "classification"), "object_id")
    return c.select(F.col("object_id").alias("cell_id"), "classification", box_polygon(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("polygon"))


@query("k1_omero", """
    select object_id as object, row_number() over (order by object_id) as secondary_object,
           concat('POLYGON ((', x0::bigint, ' ', y0::bigint, ', ', x1::bigint, ' ', y0::bigint, ', ', x1::bigint, ' ', y1::bigint, ', ', x0::bigint, ' ', y1::bigint, ', ', x0::bigint, ' ', y0::bigint, '))') as polygon,
           'cell' as "objectType", concat('p:', classification) as classification, value as total
    from {boxes} join {cells} c on c.cell_id = object_id left join {measurements} m on m.cell_id = object_id where classification is not null""")
def _(t):
    return writers.omero_rows(_objects(t), t("measurements"), label_prefix="p:")


@query("k2_anndata", """
    with o as (select cell_id, row_number() over (order by cell_id) - 1 as row_idx from {cells})
    select row_idx, 0 as col_idx, value from {measurements} join o using (cell_id)""")
def _(t):
    path = _folder(t)
    writers.write_anndata_tables(t("cells"), t("measurements"), path, t("edges"))
    return t.spark.read.parquet(f"{path}/X").withColumn("value", F.col("value").cast("double"))


def _anndata(t: Tables, table: str) -> DataFrame:
    path = _folder(t)
    writers.write_anndata_tables(t("cells"), t("measurements"), path, t("edges"))
    return t.spark.read.parquet(f"{path}/{table}")


@query("k2_anndata_obs", "select row_number() over (order by cell_id) - 1 as row_idx, cell_id, classification, x as centroid_x, y as centroid_y from {cells}")
def _(t):
    return _anndata(t, "obs").select("row_idx", "cell_id", "classification", "centroid_x", "centroid_y")


@query("k2_anndata_var", "select 'total' as name, 0 as col_idx, count(*) as rows from {measurements}")
def _(t):
    path = _folder(t)
    writers.write_anndata_tables(t("cells"), t("measurements"), path)
    return t.spark.read.parquet(f"{path}/X").join(t.spark.read.parquet(f"{path}/var"), "col_idx").groupBy("name", "col_idx").agg(F.count(F.lit(1)).alias("rows"))


@query("k2_anndata_obsp", """
    with o as (select cell_id, row_number() over (order by cell_id) - 1 as row_idx from {cells})
    select a.row_idx, b.row_idx as col_idx, 1.0::double as value from {edges} join o a on a.cell_id = src join o b on b.cell_id = dst""")
def _(t):
    return _anndata(t, "obsp").withColumn("value", F.col("value").cast("double"))


@query("k3_tile_dataset", "select cast(cell_id as varchar) as id, classification as label, c_name as image from {cells} join {customer} on c_custkey = cell_id where classification is not null")
def _(t):
    path = _folder(t)
    images = t("customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").cast("binary").alias("content"))
    labels = select.drop_unlabelled(t("cells")).select(F.col("cell_id").cast("string").alias("key"), F.col("classification").alias("label"))
    writers.write_tile_dataset(images, labels, path, 100)
    return t.spark.read.parquet(path).withColumn("image", F.col("image").cast("string"))


_PANEL = ["Brand#1", "Brand#12", "Brand#3", "Brand#7"]
_PANEL_SQL = ", ".join(f"coalesce(sum(n) filter (gene = '{g}'), 0) as \"{g}\"" for g in _PANEL)


@query("k4_expression", f"select cell_id as object, {_PANEL_SQL} from {{expr}} group by cell_id")
def _(t):
    return writers.expression_rows(t("expr"), _PANEL)


@query("k3_tile_shards", "select count(*) as tiles from {cells} join {customer} on c_custkey = cell_id where classification is not null")
def _(t):
    images = t("customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").cast("binary").alias("content"))
    labels = select.drop_unlabelled(t("cells")).select(F.col("cell_id").cast("string").alias("key"), F.col("classification").alias("label"))
    return writers.write_tile_shards(images, labels, _folder(t).removeprefix("file:"), 100).agg(F.sum("tiles").alias("tiles"))
