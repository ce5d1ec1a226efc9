"""Polygons on a grid of squares: each square has its own edges, and what its corner says of the rest.

A polygon ``array<struct<x, y>>`` is cut along its edges. A square that edges
touch holds these edges and whether its lower right corner lies within; a square
between them that no edge touches is wholly within and holds nothing else. So
what is shuffled grows with the edges and the squares, not with their product,
and points, tiles and areas are answered from the square alone.

Within and without are by ray casting to the right: edges count whose ends are
on different sides of the height (an end at the height counts as below), if the
point is left of them. From a point the answer is found on the way to the
corner: right to the border of the square, then down along it.

Polygons of fewer than three corners, or with a corner that is null or not
finite, have no squares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

_SLACK = 1e-9  # of a square's side: squares that an edge only touches have it too


def _edges(objects: DataFrame) -> DataFrame:
    """``(object_id, edge)``: corner and the corner before it."""
    polygon = F.col("polygon")
    whole = F.forall(polygon, lambda p: F.coalesce(F.abs(p["x"]) + F.abs(p["y"]) < float("inf"), F.lit(False)))
    n = F.size(polygon)
    before = F.concat(F.slice(polygon, n, 1), F.slice(polygon, F.lit(1), n - 1))
    pair = lambda p, q: F.struct(*[v.cast("double").alias(k) for k, v in (("x1", p["x"]), ("y1", p["y"]), ("x2", q["x"]), ("y2", q["y"]))])
    return objects.where((n >= 3) & whole).select("object_id", F.explode(F.zip_with(polygon, before, pair)).alias("edge"))


def _range(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(low.cast("long"), high.cast("long")))


def _at(e: Column, y: Column) -> Column:
    """Where an edge that is not level meets a height."""
    return (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]


def _spans(e: Column, y: Column) -> Column:
    return (e["y1"] > y) != (e["y2"] > y)


def _left(e: Column, x: Column, y: Column) -> Column:
    """Does the ray to the right of (x, y) meet the edge?"""
    return F.when(_spans(e, y), x < _at(e, y)).otherwise(False)


def _above(e: Column, x: Column, y: Column) -> Column:
    """Of an edge that reaches over x: does (x, y) lie above it?"""
    rising = (e["y2"] - e["y1"]) * (e["x2"] - e["x1"]) > 0
    return F.when(_spans(e, y), rising == _left(e, x, y)).otherwise(e["y1"] <= y)


def squares_of(objects: DataFrame, size: float) -> DataFrame:
    """``(object_id, bx, by, odd, edges)``: the squares of side ``size`` that the polygons of ``objects(object_id, polygon)`` meet.

    ``odd`` says whether the lower right corner lies within.
    """
    size = float(size)
    slack = size * _SLACK
    e = F.col("edge")
    x1, y1, x2, y2 = (F.col(f"edge.{c}") for c in ("x1", "y1", "x2", "y2"))
    low, high = F.least(y1, y2), F.greatest(y1, y2)
    edges = _edges(objects)

    rows = edges.withColumn("by", _range(F.floor((low - slack) / size), F.floor((high + slack) / size)))
    inside_row = lambda y: F.greatest(low, F.least(high, y))
    ends = [F.when(y1 == y2, x).otherwise(_at(e, inside_row(F.col("by") * size + y))) for x, y in ((x1, -slack), (x2, size + slack))]
    touched = rows.withColumn("bx", _range(F.floor((F.least(*ends) - slack) / size), F.floor((F.greatest(*ends) + slack) / size)))

    crossed = edges.where(F.ceil(low / size) < F.ceil(high / size)).withColumn("by", _range(F.ceil(low / size), F.ceil(high / size) - 1))
    crossed = crossed.where(_spans(e, F.col("by") * size)).withColumn("at", _at(e, F.col("by") * size))
    last = F.ceil(F.col("at") / size) - 2  # the last square whose lower right corner is left of the edge
    last = last + F.when((last + 2) * size < F.col("at"), 1).when((last + 1) * size >= F.col("at"), -1).otherwise(0)
    runs = crossed.select("object_id", "by", last.alias("last")).groupBy("object_id", "by").agg(F.sort_array(F.collect_list("last")).alias("ends"))
    runs = runs.where(F.size("ends") > 1)
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("ends") / 2).cast("int") - 1), lambda k: F.struct((F.element_at("ends", 2 * k + 1) + 1).alias("low"), F.element_at("ends", 2 * k + 2).alias("high")))
    runs = runs.select("object_id", "by", F.explode(pairs).alias("run")).where("run.low <= run.high")
    within = runs.select("object_id", _range(F.col("run.low"), F.col("run.high")).alias("bx"), "by", F.lit(True).alias("odd"))

    none = F.lit(None).cast(touched.schema["edge"].dataType)
    both = touched.select("object_id", "bx", "by", F.lit(False).alias("odd"), "edge").unionByName(within.withColumn("edge", none))
    return both.groupBy("object_id", "bx", "by").agg(F.max("odd").alias("odd"), F.collect_list("edge").alias("edges"))


def within(x: Column, y: Column, size: float) -> Column:
    """Does (x, y), a point of the square of a row of ``squares_of``, lie within the polygon?"""
    right, down = (F.col("bx") + 1) * float(size), F.col("by") * float(size)

    def passed(odd: Column, e: Column) -> Column:
        across = _left(e, x, y) != _left(e, right, y)
        along = ((e["x1"] > right) != (e["x2"] > right)) & (_above(e, right, y) != _above(e, right, down))
        return odd != (across != along)

    return F.aggregate("edges", F.col("odd"), passed)


def touches(e: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Has an edge a point in common with a box, border included? Their boxes meet, and not all corners lie on one side of the edge's line."""
    side = [(e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"]) for x in (x0, x1) for y in (y0, y1)]
    boxes = (F.least(e["x1"], e["x2"]) <= x1) & (F.greatest(e["x1"], e["x2"]) >= x0) & (F.least(e["y1"], e["y2"]) <= y1) & (F.greatest(e["y1"], e["y2"]) >= y0)
    return boxes & (F.least(*side) <= 0) & (F.greatest(*side) >= 0)


# ---- areas --------------------------------------------------------------


def _area(size: float) -> Column:
    """Area that polygon and square have in common, by the square's edges alone.

    The border of the common part has pieces of edges, and of the square's
    sides. With heights measured from the top side, pieces of edges give the
    area above them, the bottom side gives its part within times the height,
    the other sides nothing. The sign follows the direction of the corners.
    """
    x0, y0 = F.col("bx") * size, F.col("by") * size
    x1, y1 = x0 + size, y0 + size

    def share(total: Column, e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        # the part of the edge in the square, as shares of its length; a level edge at the bottom is not above it
        one = lambda start, d, low, high: F.when(d == 0, F.when((start > low) & (start <= high), 0.0).otherwise(2.0)).otherwise(F.least((low - start) / d, (high - start) / d))
        two = lambda start, d, low, high: F.when(d == 0, 1.0).otherwise(F.greatest((low - start) / d, (high - start) / d))
        first = F.greatest(F.lit(0.0), one(e["x1"], dx, x0, x1), one(e["y1"], dy, y0, y1))
        last = F.least(F.lit(1.0), two(e["x1"], dx, x0, x1), two(e["y1"], dy, y0, y1))
        middle = e["y1"] + dy * (first + last) / 2
        piece = F.when(first < last, (y1 - middle) * dx * (last - first)).otherwise(0.0)
        at = _at(e, y0)
        bottom = F.when(_spans(e, y0) & ~(x1 < at), F.greatest(F.lit(0.0), at - x0) * F.when(dy > 0, 1.0).otherwise(-1.0) * size).otherwise(0.0)
        return F.struct((total["around"] + piece).alias("around"), (total["bottom"] + bottom).alias("bottom"))

    start = F.struct(F.lit(0.0).alias("around"), F.lit(0.0).alias("bottom"))
    full = F.when(F.col("odd"), size * size).otherwise(0.0)
    # an edge runs from its second corner to its first
    return F.aggregate("edges", start, share, lambda t: F.when(F.col("ccw"), full - t["around"] - t["bottom"]).otherwise(full + t["around"] + t["bottom"]))


def _common(shapes: list, x0: float, y0: float, size: float) -> float:
    """Area that several polygons cover together in a square: between the places where an edge ends or two meet, lengths grow evenly."""
    x1, y1 = x0 + size, y0 + size
    lines = [np.array([[e["x1"], e["y1"], e["x2"], e["y2"]] for e in s["edges"]], float).reshape(-1, 4) for s in shapes]
    every = np.concatenate(lines)
    dx, dy = every[:, 2] - every[:, 0], every[:, 3] - every[:, 1]
    stops = [np.array([x0, x1]), every[:, 0], every[:, 2]]
    for level in (y0, y1):
        some = dy != 0
        stops.append(every[some, 0] + dx[some] * (level - every[some, 1]) / dy[some])
    for i in range(len(every)):
        cross = dx[i] * dy[i + 1 :] - dy[i] * dx[i + 1 :]
        some = np.flatnonzero(cross) + i + 1
        t = ((every[some, 0] - every[i, 0]) * dy[some] - (every[some, 1] - every[i, 1]) * dx[some]) / cross[some - i - 1]
        stops.append(every[i, 0] + t[(t >= 0) & (t <= 1)] * dx[i])
    xs = np.unique(np.clip(np.concatenate(stops), x0, x1))
    total = 0.0
    for low, high in zip(xs[:-1], xs[1:]):
        middle, runs = (low + high) / 2, []
        for shape, e in zip(shapes, lines):
            ex, ey = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
            with np.errstate(divide="ignore", invalid="ignore"):
                over = (e[:, 1] > y0) != (e[:, 3] > y0)
                at = e[:, 0] + ex * (y0 - e[:, 1]) / ey
                heights = (e[:, 1] + ey * (middle - e[:, 0]) / ex)[(e[:, 0] > middle) != (e[:, 2] > middle)]
            odd = bool(shape["odd"]) ^ bool(np.sum(over & (at > middle) & ~(at > x1)) % 2)
            turns = np.sort(np.clip(heights[heights > y0], y0, y1))
            marks = [*([y0] if odd else []), *turns]
            marks += [y1] * (len(marks) % 2)
            runs += zip(marks[::2], marks[1::2])
        reach = y0
        for a, b in sorted(runs):
            total += max(0.0, b - max(a, reach)) * (high - low)
            reach = max(reach, b)
    return total


def covered_squares(objects: DataFrame, size: float) -> DataFrame:
    """``(bx, by, area)``: how much of each square of side ``size`` the polygons cover together; squares without any (under 1e-12 of one) have no row."""
    size = float(size)
    polygon = F.col("polygon")
    n = F.size(polygon)
    doubled = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        F.lit(0.0),
        lambda s, k: s
        + (F.element_at(polygon, k)["x"] - polygon[0]["x"]) * (F.element_at(polygon, k % n + 1)["y"] - polygon[0]["y"])
        - (F.element_at(polygon, k % n + 1)["x"] - polygon[0]["x"]) * (F.element_at(polygon, k)["y"] - polygon[0]["y"]),
    )
    turn = objects.where(n >= 3).select("object_id", (doubled > 0).alias("ccw"))
    own = squares_of(objects, size).join(turn, "object_id").withColumn("area", F.greatest(F.lit(0.0), F.least(F.lit(size * size), _area(size))))
    own = own.where(F.col("area") > size * size * 1e-12)  # less is rounding
    kept = F.when(F.col("area") < size * size, F.struct("odd", "edges"))  # a square that one polygon fills asks for no more
    by = own.groupBy("bx", "by").agg(F.max("area").alias("area"), F.count(F.lit(1)).alias("n"), F.collect_list(kept).alias("shapes"))

    def together(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"bx": f.bx, "by": f.by, "area": [_common(s, x * size, y * size, size) for s, x, y in zip(f.shapes, f.bx, f.by)]})

    several = (F.col("n") > 1) & (F.col("area") < size * size)
    many = by.where(several).select("bx", "by", "shapes").mapInPandas(together, "bx long, by long, area double")
    return by.where(~several).select("bx", "by", "area").unionByName(many)
