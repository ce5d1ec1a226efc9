"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_WHOLE = 1 << 30


def remainder(key: Column | str, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``: the folds of the labelled rows."""
    return F.crc32((F.col(key) if isinstance(key, str) else key).cast("string").cast("binary")) % divisor


def sampled(rows: DataFrame, key: str, most: int, by: str | None = None, repeats: bool = False) -> DataFrame:
    """About ``most`` rows (of each value of ``by``), those of least hash of the key; all of them where there are fewer.

    The share to keep comes from partially aggregated counts, so nothing is
    sorted and no group is gathered. The result may exceed ``most`` by chance,
    by a few times its square root. Where keys may repeat or be null
    (``repeats``), the place of the row counts in the hash, so that a key that
    very many rows share does not come with all of them.
    """
    place = F.monotonically_increasing_id() if repeats else F.lit("sample")
    mark = F.pmod(F.xxhash64(key, place), F.lit(_WHOLE))
    groups = [by] if by else []
    counts = {(r[by] if by else None): r["n"] for r in rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).collect()}
    bound = F.lit(_WHOLE)
    for value, n in counts.items():
        if n > most:
            share = F.lit(int(_WHOLE * most / n))
            bound = F.when(F.col(by).eqNullSafe(F.lit(value)), share).otherwise(bound) if by else share
    return rows.where(mark < bound)


def labelled(labels: DataFrame, column: str, key: str = "doc_id") -> DataFrame:
    """``(key, label)``: one row per key, null keys and labels left out; of several labels the largest counts."""
    return (
        labels.where(F.col(key).isNotNull() & F.col(column).isin(0, 1))
        .groupBy(key)
        .agg(F.max(column).cast("int").alias("label"))
    )
