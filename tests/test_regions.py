"""Polygons on a grid of squares against plain versions: points, tiles, areas."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cellstrata.functions.geometry import inside
from cellstrata.operators import assign, regions, tiles


def star(r, x, y, n, low, high):
    turns = sorted(r.uniform(0, 2 * math.pi) for _ in range(n))
    return [(x + (d := r.uniform(low, high)) * math.cos(t), y + d * math.sin(t)) for t in turns]


def shapes():
    r = random.Random(3)
    out = [star(r, r.uniform(0, 60), r.uniform(0, 60), r.randrange(3, 30), 2, 25) for _ in range(25)]
    out += [[(round(x), round(y)) for x, y in star(r, 30, 30, 12, 5, 30)] for _ in range(15)]  # corners on the grid's lines
    out += [[(10, 10), (50, 10), (50, 50), (10, 50)], [(50, 10), (10, 10), (10, 50), (50, 50)], [(0, 0), (40, 0), (40, 10), (10, 10), (10, 40), (0, 40)]]
    ring = [(5, 5), (45, 5), (45, 45), (5, 45), (5, 5), (15, 15), (15, 35), (35, 35), (35, 15), (15, 15)]  # a hole, by a bridge without width
    out += [ring, [(20, 0), (40, 20), (20, 40), (0, 20)], [(-30, -30), (-10, -31), (-20, -9)]]
    return out


def frame(spark, polygons):
    rows = [(k, [(float(x), float(y)) for x, y in p], "mine") for k, p in enumerate(polygons)]
    return spark.createDataFrame(rows, "object_id long, polygon array<struct<x:double,y:double>>, edges string")


def test_points_are_as_by_whole_polygons(spark):
    r = random.Random(5)
    points = [(r.uniform(-35, 70), r.uniform(-35, 70)) for _ in range(300)] + [(float(x), float(y)) for x in range(-30, 61, 5) for y in range(-30, 61, 5)]
    points += [(float(x), float(y)) for p in shapes() for x, y in p]
    p = spark.createDataFrame([(k, *xy) for k, xy in enumerate(points)], "point_id long, x double, y double")
    polygons = frame(spark, shapes()).cache()
    want = {tuple(x) for x in p.join(F.broadcast(polygons), inside(F.col("x"), F.col("y"), F.col("polygon"))).select("point_id", "object_id").collect()}
    for size in (5.0, 7.3, 100.0):
        on = p.withColumns({"bx": F.floor(F.col("x") / size), "by": F.floor(F.col("y") / size)}).join(regions.squares_of(polygons, size), ["bx", "by"])
        assert {tuple(x) for x in on.where(regions.within(F.col("x"), F.col("y"), size)).select("point_id", "object_id").collect()} == want
    last = {}
    for point, k in want:
        last[point] = max(k, last.get(point, k))
    assert {r.point_id: r.object_id for r in assign.assign_points(p, polygons, 6.0).collect()} == last


def test_squares_do_not_copy_outlines(spark):
    """A ring of 10,000 corners: every edge is held a few times, however many squares there are."""
    ring = [(500 + (400 + 20 * math.sin(t / 7)) * math.cos(t * math.pi / 5000), 500 + 400 * math.sin(t * math.pi / 5000)) for t in range(10_000)]
    for size, squares in ((50.0, 150), (10.0, 4000)):
        row = regions.squares_of(frame(spark, [ring]), size).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("edges")).alias("held"), F.sum((F.size("edges") == 0).cast("int")).alias("within")).first()
        assert row.n > squares and row.held < 25_000 and row.within > 0.5 * row.n


def meets(polygon, x0, y0, x1, y1):
    """Has a polygon a point in common with a box? A corner of one in the other, or edges that cross or touch."""
    n = len(polygon)
    edges = [(polygon[i - 1], polygon[i]) for i in range(n)]
    if any(x0 <= x <= x1 and y0 <= y <= y1 for x, y in polygon):
        return True
    if sum((a[1] > y0) != (b[1] > y0) and x0 < (b[0] - a[0]) * (y0 - a[1]) / (b[1] - a[1]) + a[0] for a, b in edges) % 2:
        return True
    turn = lambda p, q, s: (q[0] - p[0]) * (s[1] - p[1]) - (q[1] - p[1]) * (s[0] - p[0])
    box = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    return any(
        turn(a, b, p) * turn(a, b, q) <= 0 and turn(p, q, a) * turn(p, q, b) <= 0 and max(min(a[0], b[0]), min(p[0], q[0])) <= min(max(a[0], b[0]), max(p[0], q[0])) and max(min(a[1], b[1]), min(p[1], q[1])) <= min(max(a[1], b[1]), max(p[1], q[1]))
        for a, b in edges
        for p, q in zip(box, box[1:] + box[:1])
    )


@pytest.mark.parametrize("w", [4, 11])
def test_tiles_that_touch_regions(spark, w):
    grid = tiles.tile_grid(spark, 70, 70, w, 3)
    boxes = [tuple(r) for r in grid.select("tile_id", "x", "y").collect()]
    for some in (shapes()[:8], shapes()[25:33], shapes()[40:41], shapes()[43:44], shapes()[44:]):
        want = {k for k, x, y in boxes if any(meets(p, x, y, x + w, y + w) for p in some)}
        got = [r.tile_id for r in tiles.tiles_in_regions(grid, frame(spark, some), 5.0).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert tiles.tiles_in_regions(grid, frame(spark, []), 5.0).count() == 0


def area(p):
    return abs(sum(p[i - 1][0] * p[i][1] - p[i][0] * p[i - 1][1] for i in range(len(p)))) / 2


def test_areas_sum_to_the_polygon_s(spark):
    for p in [[(3.3, 2.1), (47.9, 11.7), (20.5, 48.2)], *shapes()[26:28], *shapes()[40:]]:
        for size in (5.0, 8.7):
            got = regions.covered_squares(frame(spark, [p]), size).agg(F.sum("area"), F.max("area"), F.min("area")).first()
            assert math.isclose(got[0], area(p), rel_tol=1e-9) and 0 < got[2] and got[1] <= size * size + 1e-9


def test_areas_of_several_polygons_count_once(spark):
    squares = [[(0, 0), (20, 0), (20, 20), (0, 20)], [(10, 10), (33, 10), (33, 30), (10, 30)], [(12, 12), (14, 12), (14, 14), (12, 14)]]
    assert math.isclose(regions.covered_squares(frame(spark, squares), 7.0).agg(F.sum("area")).first()[0], 400 + 23 * 20 - 100, rel_tol=1e-9)
    diamonds = [[(20, 0), (40, 20), (20, 40), (0, 20)], [(30, 0), (50, 20), (30, 40), (10, 20)]]
    assert math.isclose(regions.covered_squares(frame(spark, diamonds), 6.0).agg(F.sum("area")).first()[0], 2 * 800 - 450, rel_tol=1e-9)
    r = random.Random(9)
    stars = [star(r, r.uniform(20, 40), r.uniform(20, 40), 9, 5, 20) for _ in range(6)]
    odd = lambda p, x, y: sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(p, p[1:] + p[:1])) % 2
    step = 0.1
    rough = step * step * sum(any(odd(p, (i + 0.5) * step, (j + 0.5) * step) for p in stars) for i in range(700) for j in range(700))
    assert math.isclose(regions.covered_squares(frame(spark, stars), 9.0).agg(F.sum("area")).first()[0], rough, rel_tol=3e-3)


def test_labels_within_a_base(spark):
    grid = spark.createDataFrame([(x, y, 2 + (x > 3)) for x in range(8) for y in range(8)], "gx long, gy long, value int")
    base = frame(spark, [[(5, 5), (75, 5), (75, 25), (5, 25)], [(5, 45), (35, 45), (35, 55), (5, 55)]])
    got = sorted((r.value, r.tiles, round(r.area, 6)) for r in tiles.regions_by_label(grid, 10, base).collect())
    assert got == [(2, 8, 300.0), (2, 12, 700.0), (3, 12, 700.0)]


def test_odd_polygons(spark):
    some = spark.createDataFrame(
        [(1, None), (2, []), (3, [(0.0, 0.0), (5.0, 5.0)]), (4, [(0.0, 0.0), (None, 5.0), (5.0, 5.0)]), (5, [(0.0, 0.0), (float("nan"), 5.0), (5.0, 5.0)]), (6, [(1.0, 1.0)] * 4), (7, [(0.0, 0.0), (3.0, 3.0), (9.0, 9.0)])],
        "object_id long, polygon array<struct<x:double,y:double>>",
    )
    assert regions.covered_squares(some, 4.0).count() == 0
    assert {r.object_id for r in regions.squares_of(some, 4.0).select("object_id").distinct().collect()} <= {6, 7}
