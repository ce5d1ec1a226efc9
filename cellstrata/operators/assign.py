"""Spatial assignment and geometry."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from cellstrata.operators.graph import near_pairs
from cellstrata.operators.regions import squares_of, within

#: Feature types of a count matrix; only the first is expression.
FEATURE_TYPES = (
    "Gene Expression",
    "Blank Codeword",
    "Negative Control Codeword",
    "Negative Control Probe",
    "Unassigned Codeword",
    "Deprecated Codeword",
    "Genomic Control",
)


def assign_points(points: DataFrame, objects: DataFrame, size: float, width: float | None = None, height: float | None = None) -> DataFrame:
    """``(point_id, object_id)``: the object ``(object_id, polygon)`` that holds the point; of several the one of largest id, drawn last.

    Points meet the grid squares of side ``size`` that the objects have, by an
    equi join; each is tested against the edges of its square alone. Points
    outside the image, or in no object, have no row.
    """
    p = points.where("x is not null and y is not null")
    if width is not None:
        p = p.where(F.col("x").between(0, width) & F.col("y").between(0, height))
    p = p.withColumns({"bx": F.floor(F.col("x") / size), "by": F.floor(F.col("y") / size)})
    hit = p.join(squares_of(objects, size), ["bx", "by"]).where(within(F.col("x"), F.col("y"), size))
    return hit.groupBy("point_id").agg(F.max("object_id").alias("object_id"))


def nearest_per_object(assigned: DataFrame) -> DataFrame:
    """Of several points in an object the one nearest to its centroid: rows ``(object_id, point_id, distance, ...)``, ties by id."""
    w = Window.partitionBy("object_id").orderBy("distance", "point_id")
    return assigned.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def attach_labels(cells: DataFrame, clusters: DataFrame, default: str | None = None) -> DataFrame:
    """``classification`` from ``clusters(cell_id, label)`` where there is one, else what it was (or ``default``)."""
    own = F.col("classification") if default is None else F.lit(default)
    return cells.join(clusters.select("cell_id", "label"), "cell_id", "left").withColumn("classification", F.coalesce("label", own)).drop("label")


def filter_features(features: DataFrame, include: Sequence[str] = FEATURE_TYPES[:1], control_prefix: str | None = "NegPrb") -> DataFrame:
    out = features.where(F.col("feature_type").isin(*include))
    return out if control_prefix is None else out.where(~F.col("gene").startswith(control_prefix))


def attach_expression(cells: DataFrame, expr: DataFrame) -> DataFrame:
    return cells.join(expr, "cell_id")


def consolidate_to_annotation(cells: DataFrame, expr: DataFrame) -> DataFrame:
    """``(annotation_id, gene, n)``: the cells' counts summed in their annotation."""
    own = expr.join(cells.select("cell_id", "annotation_id"), "cell_id")
    return own.groupBy("annotation_id", "gene").agg(F.sum("n").alias("n"))


def in_tissue_only(spots: DataFrame) -> DataFrame:
    return spots.where("in_tissue = 1")


def spot_geometry(spots: DataFrame, diameter_um: float, pixel_um: float) -> DataFrame:
    """The box of each spot's circle: rounded radius off the centre, rounded diameter."""
    radius, diameter = round(diameter_um / pixel_um / 2), round(diameter_um / pixel_um)
    return spots.withColumns({"x0": F.col("x") - radius, "y0": F.col("y") - radius, "width": F.lit(diameter), "height": F.lit(diameter)})


def pseudo_spot_grid(spark, width: float, height: float, diameter: float, pitch: float, hexagonal: bool = True, half_pitch: bool = False) -> DataFrame:
    """``(spot_id, row, col, x, y)``: centres of a grid; every second hexagonal row is shifted by half the diameter (or pitch)."""
    step = round(math.sqrt(3) / 2 * pitch) if hexagonal else round(pitch)
    rows, cols = max(0, math.ceil(height / step)), max(0, math.ceil(width / pitch))
    shift = (pitch if half_pitch else diameter) / 2 if hexagonal else 0.0
    grid = spark.range(rows).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(max(0, cols - 1)))).alias("col"))
    x = F.col("col") * float(pitch) + F.when(F.col("row") % 2 == 1, shift).otherwise(0.0)
    return grid.where(F.lit(cols > 0)).select(
        F.concat_ws("_", "row", "col").alias("spot_id"), "row", F.col("col").cast("long").alias("col"), x.alias("x"), (F.col("row") * float(step)).alias("y")
    )


def spots_in_regions(spots: DataFrame, regions: DataFrame, size: float) -> DataFrame:
    """Spots whose centre lies in a region ``(object_id, polygon)``."""
    hit = assign_points(spots.select(F.col("spot_id").alias("point_id"), "x", "y"), regions, size)
    return spots.join(hit.select(F.col("point_id").alias("spot_id")), "spot_id", "left_semi")


def aggregate_cells_to_spots(cells: DataFrame, expr: DataFrame, spots: DataFrame, radius: float) -> DataFrame:
    """``(spot_id, gene, n)``: counts of the cells at most ``radius`` from a spot's centre."""
    near = near_pairs(cells.select(F.col("cell_id").alias("id"), "x", "y"), spots.select(F.col("spot_id").alias("id"), "x", "y"), radius)
    near = near.select(F.col("a").alias("cell_id"), F.col("b").alias("spot_id"))
    return near.join(expr, "cell_id").groupBy("spot_id", "gene").agg(F.sum("n").alias("n"))
