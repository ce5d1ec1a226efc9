"""Comparisons of measurements."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def compared(value: Column, op: str, threshold: float) -> Column:
    """``value op threshold``; equality within 1e-9, an unknown operator means >=."""
    near = F.abs(value - F.lit(float(threshold))) < 1e-9
    return {
        ">": value > threshold,
        "<": value < threshold,
        "<=": value <= threshold,
        "==": near,
        "!=": ~near,
    }.get(op, value >= threshold)
