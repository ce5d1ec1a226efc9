"""Column expressions on polygons, ``array<struct<x, y>>``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def inside(x: Column, y: Column, polygon: Column) -> Column:
    """Ray casting over ``array<struct<x, y>>``: does a ray to the right cross the border an odd number of times?"""
    n = F.size(polygon)

    def crossed(odd: Column, i: Column) -> Column:
        p, q = F.element_at(polygon, i + 1), F.element_at(polygon, F.when(i == 0, n).otherwise(i))
        over = (p["y"] > y) != (q["y"] > y)
        at = (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]
        return F.when(over & (x < at), ~odd).otherwise(odd)

    return F.when(n < 3, F.lit(False)).otherwise(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), crossed))


def box_polygon(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1))
