"""Writers (K1-K4)."""

from __future__ import annotations

import io
import tarfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, functions as F

from cellstrata.operators.graph import dense_index
from cellstrata.plans.lineage import cut, distinct_names, small, written


def omero_rows(objects: DataFrame, measurements: DataFrame, exclude: tuple[str, ...] = (), label_prefix: str = "") -> DataFrame:
    """Rows of K1: ``objects(cell_id, classification, polygon)`` with a class and more than three corners, in the order of cell_id.

    The outline is closed and has whole coordinates; each measurement is a
    column.
    """
    kept = objects.where("classification is not null and size(polygon) > 3")
    corner = lambda p: F.concat_ws(" ", F.round(p["x"]).cast("long"), F.round(p["y"]).cast("long"))
    ring = F.concat(F.col("polygon"), F.array(F.col("polygon")[0]))
    outline = F.concat(F.lit("POLYGON (("), F.array_join(F.transform(ring, corner), ", "), F.lit("))"))
    m = measurements.where(~F.col("name").isin(*exclude)) if exclude else measurements
    names = distinct_names(m, "name")
    wide = m.groupBy("cell_id").pivot("name", names).agg(F.first("value"))
    out = dense_index(kept, "cell_id", "secondary_object").join(wide, "cell_id", "left")
    return out.select(
        F.col("cell_id").alias("object"),
        (F.col("secondary_object") + 1).alias("secondary_object"),
        outline.alias("polygon"),
        F.lit("cell").alias("objectType"),
        F.concat(F.lit(label_prefix), "classification").alias("classification"),
        *[F.col(f"`{n}`") for n in names],
    )


def write_omero_csv(objects: DataFrame, measurements: DataFrame, path: str, exclude: tuple[str, ...] = (), label_prefix: str = "") -> None:
    """K1: gzip CSV with a header, one file for each partition."""
    omero_rows(objects, measurements, exclude, label_prefix).write.csv(path, header=True, compression="gzip")


def write_anndata_tables(cells: DataFrame, measurements: DataFrame, path: str, edges: DataFrame | None = None) -> None:
    """K2: Parquet tables obs, var, X (row_idx, col_idx, value) and, with edges, obsp (of 1.0).

    Variables are the union of all names, with u for the micro sign; edges to
    cells that are not here are left out.
    """
    obs = cut(dense_index(cells.select("cell_id", "classification", F.col("x").alias("centroid_x"), F.col("y").alias("centroid_y")), "cell_id"))
    var = cut(dense_index(measurements.select("name").distinct(), "name", "col_idx"))
    x = measurements.join(obs.select("cell_id", "row_idx"), "cell_id").join(small(var), "name").select("row_idx", "col_idx", F.col("value").cast("float").alias("value"))
    obs.write.parquet(f"{path}/obs")
    var.withColumn("name", F.translate("name", "µμ", "uu")).write.parquet(f"{path}/var")
    x.write.parquet(f"{path}/X")
    if edges is not None:
        at = lambda side, name: obs.select(F.col("cell_id").alias(side), F.col("row_idx").alias(name))
        pairs = edges.join(at("src", "row_idx"), "src").join(at("dst", "col_idx"), "dst")
        pairs.select("row_idx", "col_idx", F.lit(1.0).cast("float").alias("value")).write.parquet(f"{path}/obsp")


def _labelled(tiles: DataFrame, labels: DataFrame) -> DataFrame:
    """``(key, label, content)``, dealt to tasks by key: tables of few bytes may hold very many tiles, which one task would write alone, with a hash table of all labels."""
    return tiles.select("key", "content").join(labels.select("key", "label").hint("merge"), "key")


def write_tile_dataset(tiles: DataFrame, labels: DataFrame, path: str, shard_rows: int = 1000) -> None:
    """K3: ``(id, label, image)`` in Parquet files of at most ``shard_rows`` rows; ``tiles(key, content)``, ``labels(key, label)``."""
    rows = _labelled(tiles, labels).select(F.col("key").alias("id"), "label", F.col("content").alias("image"))
    rows.write.option("maxRecordsPerFile", shard_rows).parquet(path)


def write_tile_shards(tiles: DataFrame, labels: DataFrame, path: str, shard_rows: int = 1000, extension: str = "png") -> DataFrame:
    """K3 as tar files of at most ``shard_rows`` tiles: ``<id>.<extension>`` and ``<id>.cls`` for each; the manifest ``(file, tiles)``.

    Tasks write under fresh names into ``path``, a folder that every executor
    reaches, and only files of the manifest count, so a repeated task does no harm.
    """
    rows = _labelled(tiles, labels).select(F.col("key").cast("string").alias("id"), F.col("label").cast("string").alias("label"), F.col("content").cast("binary").alias("image"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        files.create_dir(folder, recursive=True)
        shard, stream, name, n = None, None, "", 0

        def done() -> pa.RecordBatch:
            shard.close()
            stream.close()
            return pa.RecordBatch.from_pylist([{"file": name, "tiles": n}])

        for batch in batches:
            for key, label, image in zip(*(c.to_pylist() for c in batch.columns)):
                if shard is not None and n == shard_rows:
                    yield done()
                    shard = None
                if shard is None:
                    base, n = f"shard-{uuid.uuid4().hex}.tar", 0
                    name, stream = f"{path}/{base}", files.open_output_stream(f"{folder}/{base}", compression=None)
                    shard = tarfile.open(fileobj=stream, mode="w|")
                for suffix, content in ((extension, image or b""), ("cls", (label or "").encode())):
                    info = tarfile.TarInfo(f"{key}.{suffix}")
                    info.size = len(content)
                    shard.addfile(info, io.BytesIO(content))
                n += 1
        if shard is not None:
            yield done()

    return written(rows.mapInArrow(write, "file string, tiles long"), "shards")


def expression_rows(expr: DataFrame, genes: list[str], labels: DataFrame | None = None) -> DataFrame:
    """Rows of K4: one for each cell, 0 where a gene of the panel is not seen."""
    wide = expr.groupBy("cell_id").pivot("gene", genes).agg(F.sum("n")).na.fill(0)
    wide = wide if labels is None else labels.select("cell_id", "label").join(wide, "cell_id")
    return wide.withColumnRenamed("cell_id", "object")


def write_expression_csv(expr: DataFrame, path: str, labels: DataFrame | None = None) -> None:
    """K4: the dense matrix as CSV."""
    genes = distinct_names(expr, "gene")
    expression_rows(expr, genes, labels).write.csv(path, header=True)
