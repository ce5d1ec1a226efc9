"""Choosing cells and measurements (Q1-Q6, A4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def cells_in(cells: DataFrame, annotation_ids: DataFrame | Sequence[int]) -> DataFrame:
    """Cells of the given annotations: a list, or a frame with ``annotation_id``."""
    if isinstance(annotation_ids, DataFrame):
        return cells.join(annotation_ids.select("annotation_id"), "annotation_id", "left_semi")
    return cells.where(F.col("annotation_id").isin(*annotation_ids))


def class_inventory(cells: DataFrame) -> DataFrame:
    """Distinct classes, without null."""
    return cells.where("classification is not null").select("classification").distinct()


def opponents(cells: DataFrame, targets: Sequence[str]) -> DataFrame:
    """All classes but the targets."""
    return class_inventory(cells).where(~F.col("classification").isin(*targets))


def effective_class(cells: DataFrame, annotations: DataFrame, by: str = "detection") -> DataFrame:
    """``cells`` with ``effective``: their own class, or that of their annotation."""
    if by == "detection":
        return cells.withColumn("effective", F.col("classification"))
    if by != "annotation":
        raise ValueError(f"by: {by!r} is neither detection nor annotation")
    parents = annotations.select("annotation_id", F.col("classification").alias("effective"))
    return cells.join(parents, "annotation_id", "left")


def sample_cells(cells: DataFrame, n: int, seed: int = 0, strict: bool = True) -> DataFrame:
    """``n`` cells in the order of a seeded hash; 0 means all. Fewer cells raise, or are all taken if not ``strict``."""
    if n == 0:
        return cells
    out = cells.orderBy(F.xxhash64("cell_id", F.lit(seed)), "cell_id").limit(n)
    if strict and (have := out.count()) < n:
        raise ValueError(f"{n} cells are asked for, there are {have}")
    return out


def split_target_opponent(cells: DataFrame, targets: Sequence[str], against: Sequence[str] | None = None) -> DataFrame:
    """``(cell_id, label)``: 1 for targets, 0 for opponents (default: every other class)."""
    c = F.col("classification")
    label = F.when(c.isin(*targets), 1).when(c.isNotNull() if against is None else c.isin(*against), 0)
    return cells.select("cell_id", label.alias("label")).where("label is not null")


def replace_measurement(measurements: DataFrame, name: str, new: DataFrame) -> DataFrame:
    """Drop what is stored under ``name``, add ``new(cell_id, value)`` under it."""
    return measurements.where(F.col("name") != name).unionByName(new.select("cell_id", F.lit(name).alias("name"), "value"))


def drop_unlabelled(cells: DataFrame) -> DataFrame:
    return cells.where("classification is not null")
