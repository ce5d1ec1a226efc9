"""Labelled data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cellstrata.operators.graph import dense_index
from cellstrata.plans.lineage import cut, small


def join_images_labels(images: DataFrame, tables: DataFrame) -> DataFrame:
    """Images and object tables meet by ``key``; objects without a class are left out."""
    return images.join(tables.where("classification is not null"), "key")


def encode_labels(rows: DataFrame, order: str = "key") -> DataFrame:
    """``rows`` with ``label``: 0, 1, ... in the order in which the classes first appear."""
    first = rows.groupBy("classification").agg(F.min(order).alias("first"))
    index = first.withColumn("label", F.row_number().over(Window.orderBy("first", "classification")) - 1).drop("first")
    return rows.join(index, "classification")


def class_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("classification").agg(F.count(F.lit(1)).alias("n"))


def balance_classes(rows: DataFrame, n: int, key: str = "key", seed: int = 0) -> DataFrame:
    """``n`` rows of every class, drawn with replacement by a seeded hash.

    Rows are numbered over all classes by range partitions, so that no class is
    sorted in one task; a class begins where the smaller ones end.
    """
    marked = rows.where("classification is not null").withColumn("__k", F.struct("classification", F.xxhash64(key, F.lit(seed)).alias("h"), F.col(key).alias("k")))
    numbered = dense_index(marked, "__k", "__place").drop("__k")
    counts = class_counts(rows).where("classification is not null")
    before = F.sum("n").over(Window.orderBy("classification")) - F.col("n")
    counts = small(cut(counts.withColumn("before", before)))  # one row for each class
    numbered = numbered.join(counts.drop("n"), "classification").withColumn("__r", F.col("__place") - F.col("before")).drop("before", "__place")
    draws = counts.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    draws = draws.select("classification", "draw", F.pmod(F.xxhash64("classification", "draw", F.lit(seed)), F.col("n")).alias("__r"))
    return draws.join(numbered, ["classification", "__r"]).drop("__r")


def train_validation_split(rows: DataFrame, share: float = 0.9, key: str = "key", seed: int = 0) -> DataFrame:
    """``rows`` with ``part``: train for about ``share`` of the keys, by a seeded hash; a key is always on one side."""
    mark = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000))
    return rows.withColumn("part", F.when(mark < int(share * 1_000_000), "train").otherwise("validation"))


def evaluate(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """``(truth, predicted, n, share, accuracy)``: the confusion matrix, shares of its rows, and the accuracy over all."""
    n = rows.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    by = n.groupBy(truth).agg(F.sum("n").alias("row"))
    total = n.agg((F.sum(F.when(F.col(truth).eqNullSafe(F.col(predicted)), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    out = n.join(by.withColumnRenamed(truth, "__t"), F.col(truth).eqNullSafe(F.col("__t"))).crossJoin(F.broadcast(total))
    return out.select(F.col(truth).alias("truth"), F.col(predicted).alias("predicted"), "n", (F.col("n") / F.col("row")).alias("share"), "accuracy")


def validate_tiles(tiles: DataFrame) -> DataFrame:
    """One row: is every tile square, are they of one size and one extension? ``tiles(w, h, extension)``"""
    return tiles.agg(
        F.coalesce(F.every(F.col("w") == F.col("h")), F.lit(True)).alias("square"),
        (F.count_distinct("w", "h") <= 1).alias("one_size"),
        (F.count_distinct("extension") <= 1).alias("one_extension"),
    )
