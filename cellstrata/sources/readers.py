"""Readers of vendor files (S1-S11). Columns go by position, as the files have no agreed names; schemas are declared.

Compressed text arrives as one partition, so what is large is dealt out anew by
its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from cellstrata.plans.lineage import cut, small


def _csv(spark: SparkSession, path: str | list[str], schema: str, header: bool = True, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).csv(path, header=header, sep=sep, quote='"', mode="PERMISSIVE", enforceSchema=True)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(i, value)``: lines of text with their number from 0, in the order of file names and of places in a file.

    Lines are counted for each block of a file, a row for each, and get their
    number from these counts and their place within the block.
    """
    where = {"__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start"), "__id": F.monotonically_increasing_id()}
    lines = spark.read.text(path).select("value", *[c.alias(n) for n, c in where.items()])
    blocks = lines.groupBy("__file", "__block").agg(F.min("__id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("__file", "__block")) - F.col("n")
    shift = small(cut(blocks.select("__file", "__block", (before - F.col("first")).alias("shift"))))
    return lines.join(shift, ["__file", "__block"]).select((F.col("__id") + F.col("shift")).alias("i"), "value")


def read_xenium_cells(spark: SparkSession, path: str) -> DataFrame:
    """S1"""
    schema = (
        "cell_id string, x double, y double, transcript_counts double, control_probe_counts double, control_codeword_counts double, "
        "total_counts double, cell_area double, nucleus_area double"
    )
    return _csv(spark, path, schema).repartition("cell_id")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """``(cell_id, label)``; rows without a number as label are left out."""
    rows = _csv(spark, path, "barcode string, cluster string")
    out = rows.select(F.regexp_replace("barcode", '"', "").alias("cell_id"), F.expr("try_cast(trim(cluster) as int)").alias("label"))
    return out.where("label is not null and cell_id is not null")


def read_mtx(spark: SparkSession, barcodes: str, features: str, matrix: str) -> DataFrame:
    """S3: ``expr(cell_id, feature_id, gene, feature_type, n)`` from numbered barcodes and features and 1-based triplets after three header lines."""
    cells = numbered_lines(spark, barcodes).select((F.col("i") + 1).alias("b"), F.col("value").alias("cell_id"))
    parts = F.split("value", "\t")
    genes = numbered_lines(spark, features).select(
        (F.col("i") + 1).alias("f"), parts[0].alias("feature_id"), parts[1].alias("gene"), parts[2].alias("feature_type")
    )
    triple = F.split(F.when(F.col("i") >= 3, F.trim("value")), "\\s+")  # header lines are never cast, wherever the filter is put
    rows = numbered_lines(spark, matrix).where("i >= 3 and trim(value) <> ''")
    rows = rows.select(triple[0].cast("long").alias("f"), triple[1].cast("long").alias("b"), triple[2].cast("long").alias("n"))
    return rows.join(genes, "f").join(cells, "b").select("cell_id", "feature_id", "gene", "feature_type", "n")


def read_visium_positions(spark: SparkSession, path: str, headered: bool = True) -> DataFrame:
    """S4"""
    return _csv(spark, path, "barcode string, in_tissue int, row int, col int, y int, x int", headered)


def read_cosmx(spark: SparkSession, fov: str, metadata: str, exprmat: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``fovs(fov, x, y)``, ``cells(fov, cell_id, x, y)``, ``expr(fov, cell_id, gene, n)``; the wide matrix becomes long, zeros left out."""
    fovs = _csv(spark, fov, "fov int, x double, y double")
    cells = _csv(spark, metadata, "fov int, cell_id int, c2 string, c3 string, c4 string, c5 string, x double, y double").select("fov", "cell_id", "x", "y")
    wide = spark.read.csv(exprmat, header=True)
    first, second, *genes = wide.columns
    wide = wide.select(F.col(f"`{first}`").cast("int").alias("fov"), F.col(f"`{second}`").cast("int").alias("cell_id"), *[F.col(f"`{g}`").cast("double").alias(g) for g in genes])
    return fovs, cells, wide.unpivot(["fov", "cell_id"], [F.col(f"`{g}`") for g in genes], "gene", "n").where("n <> 0")


def read_st_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``(x, y, gene, n)`` of a tab matrix whose rows are named <x>x<y>; zeros left out."""
    wide = spark.read.csv(path, header=True, sep="\t")
    key, *genes = wide.columns
    at = F.split(F.col(f"`{key}`"), "x")
    wide = wide.select(at[0].cast("double").alias("x"), at[1].cast("double").alias("y"), *[F.col(f"`{g}`").cast("double").alias(g) for g in genes])
    return wide.unpivot(["x", "y"], [F.col(f"`{g}`") for g in genes], "gene", "n").where("n <> 0")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """``(cell_id, classification, x_um, y_um)``"""
    schema = "c0 string, cell_id string, c2 string, c3 string, classification string, c5 string, c6 string, x_um double, y_um double"
    return _csv(spark, path, schema, sep="\t").select("cell_id", "classification", "x_um", "y_um")


def read_lr_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Rows of fewer than three fields are left out."""
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.split("value", ",").alias("f")).where("size(f) >= 3")
    clean = lambda i: F.trim(F.regexp_replace(F.col("f")[i], '"', ""))
    pairs = rows.select(clean(1).alias("ligand"), clean(2).alias("receptor"))
    return pairs.where("not (lower(ligand) = 'ligand' and lower(receptor) = 'receptor')")


def read_go(spark: SparkSession, gene_map: str, assoc: str, terms: str, taxon: int = 9606) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``gene_map(symbol, gene_id)``, ``assoc(gene_id, go_id, ns)`` of the taxon, ``terms(go_id, name, ns)``; tab files with a header."""
    return (
        _csv(spark, gene_map, "symbol string, gene_id long", sep="\t"),
        _csv(spark, assoc, "taxon int, gene_id long, go_id string, ns string", sep="\t").where(F.col("taxon") == taxon).drop("taxon"),
        _csv(spark, terms, "go_id string, name string, ns string", sep="\t"),
    )


def read_object_tables(spark: SparkSession, paths: str | list[str], images: DataFrame | None = None) -> DataFrame:
    """``(key, classification)``, key = <file stem>/<Object ID>; with ``images(key)``, an object without an image raises."""
    rows = spark.read.csv(paths, header=True, sep="\t").withColumn("__f", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]+)*$", 1))
    out = rows.select(F.concat_ws("/", "__f", F.col("`Object ID`")).alias("key"), F.col("Classification").alias("classification"))
    if images is not None:
        lost = [r["key"] for r in out.join(images, "key", "left_anti").limit(5).collect()]
        if lost:
            raise ValueError(f"objects without an image: {', '.join(lost)}")
    return out


def read_tile_images(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """``(key, extension, content)``, key = <folder>/<file name up to its first dot>."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+)/([^/.]+)[^/]*$", 1), F.regexp_extract("path", r"([^/]+)/([^/.]+)[^/]*$", 2)
    return files.select(F.concat_ws("/", *name).alias("key"), F.regexp_extract("path", r"\.([^./]+)$", 1).alias("extension"), "content")


def checked(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of ``schema``, cast; a missing one raises."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema])
