"""Coordinate registration (R1-R11): each takes a frame with x and y and returns it with new ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _put(df: DataFrame, x: Column, y: Column) -> DataFrame:
    return df.withColumns({"x": x, "y": y})


def to_pixels(df: DataFrame, pixel_size: float) -> DataFrame:
    return _put(df, F.col("x") / pixel_size, F.col("y") / pixel_size)


def flip(df: DataFrame, width: float, height: float, horizontal: bool = False, vertical: bool = False) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return _put(df, F.lit(width) - x if horizontal else x, F.lit(height) - y if vertical else y)


def rotate(df: DataFrame, degrees: int | str, width: float, height: float) -> DataFrame:
    """By a multiple of 90 degrees; anything else leaves the points where they are."""
    x, y, w, h = F.col("x"), F.col("y"), F.lit(width), F.lit(height)
    turns = {"-90": (y, w - x), "270": (y, w - x), "180": (w - x, h - y), "-180": (w - x, h - y), "90": (h - y, x), "-270": (h - y, x)}
    return _put(df, *turns.get(str(degrees), (x, y)))


def scale(df: DataFrame, manual: float = 1.0, source: float = 1.0, target: float = 1.0) -> DataFrame:
    """Multiply by ``manual`` and ``target``, divide by ``source``."""
    return _put(df, F.col("x") * manual / source * target, F.col("y") * manual / source * target)


def affine(df: DataFrame, m: Sequence[float]) -> DataFrame:
    """``m``: the rows (a, b, c) and (d, e, f) of a 2x3 matrix."""
    a, b, c, d, e, f = map(float, m)
    x, y = F.col("x"), F.col("y")
    return _put(df, a * x + b * y + c, d * x + e * y + f)


def inverse_affine(df: DataFrame, m: Sequence[Sequence[float]]) -> DataFrame:
    """Apply the inverse of a 3x3 affine matrix; a determinant below 1e-9 raises."""
    (a, b, c), (d, e, f) = m[0], m[1]
    det = a * e - b * d
    if abs(det) < 1e-9:
        raise ValueError("the affine matrix has no inverse")
    return affine(df, (e / det, -b / det, (b * f - c * e) / det, -d / det, a / det, (c * d - a * f) / det))


def shift(df: DataFrame, dx: float, dy: float) -> DataFrame:
    return _put(df, F.col("x") + dx, F.col("y") + dy)


def legacy_spots(df: DataFrame, m: Sequence[float], ratio: float = 0.0, dx: float = 0.0, dy: float = 0.0) -> DataFrame:
    """Nine numbers of a transposed 3x3 affine matrix, a ratio of pixel sizes (0: none), a shift."""
    out = affine(df, (m[0], m[3], m[6], m[1], m[4], m[7]))
    out = out if ratio == 0 else scale(out, target=ratio)
    return shift(out, dx, dy)


def to_origin(df: DataFrame, fovs: DataFrame) -> DataFrame:
    """Subtract the smallest x and y of the fields of view (one row)."""
    low = fovs.agg(F.min("x").alias("__x0"), F.min("y").alias("__y0"))
    return _put(df.crossJoin(F.broadcast(low)), F.col("x") - F.col("__x0"), F.col("y") - F.col("__y0")).drop("__x0", "__y0")


def _cubic(d: Column) -> Column:
    """Cubic B-spline kernel."""
    a = F.abs(d)
    return F.when(a < 1, (4 - 6 * a * a + 3 * a * a * a) / 6).when(a < 2, F.pow(2 - a, 3) / 6).otherwise(0.0)


def bspline(df: DataFrame, grid: DataFrame, intervals: int, width: float, height: float, key: str = "cell_id") -> DataFrame:
    """Warp by coefficients ``grid(i, j, cx, cy)``, of which there are (intervals + 3)**2; beyond the grid they are 0.

    Points without any coefficient in reach land on (0, 0).
    """
    u = F.col("x") * intervals / (F.lit(float(width)) - 1) + 1
    v = F.col("y") * intervals / (F.lit(float(height)) - 1) + 1
    steps = F.array(*[F.lit(k) for k in (-1, 0, 1, 2)])
    near = (
        df.select(key, u.alias("u"), v.alias("v"))
        .select(key, "u", "v", F.explode(steps).alias("di"))
        .select(key, "u", "v", (F.floor("u") + F.col("di")).cast("int").alias("i"), F.explode(steps).alias("dj"))
        .select(key, "u", "v", "i", (F.floor("v") + F.col("dj")).cast("int").alias("j"))
    )
    weight = _cubic(F.col("u") - F.col("i")) * _cubic(F.col("v") - F.col("j"))
    if (intervals + 3) ** 2 <= 1_000_000:
        grid = F.broadcast(grid)
    moved = near.join(grid, ["i", "j"]).groupBy(key).agg(F.sum(weight * F.col("cx")).alias("__x"), F.sum(weight * F.col("cy")).alias("__y"))
    out = df.join(moved, key, "left")
    return _put(out, F.coalesce("__x", F.lit(0.0)), F.coalesce("__y", F.lit(0.0))).drop("__x", "__y")


def _whole(df: DataFrame) -> DataFrame:
    """Coordinates at the nearest whole numbers, halves upward."""
    return _put(df, F.floor(F.col("x") + 0.5).cast("double"), F.floor(F.col("y") + 0.5).cast("double"))


def register(df: DataFrame, params: Mapping, mode: str = "none", grid: DataFrame | None = None, key: str = "cell_id", whole_pixels: bool = False) -> DataFrame:
    """Flip, rotate, divide by the source scale, warp, multiply by the target scale, shift; missing parameters change nothing.

    Mode "affine" applies the matrix alone. Mode "bspline" applies it, rounds to
    whole pixels and warps these by ``grid`` over the target image at the
    target scale, int(target_width / target_scale) + 0.5 wide (the source's
    width and height where the target's are not given). With ``whole_pixels``
    the warped point is rounded too, and its scaled place cut to an integer.
    """
    w, h = params.get("width", 0), params.get("height", 0)
    target = params.get("target_scale", 1.0)
    out = flip(df, w, h, params.get("flip_horizontal", False), params.get("flip_vertical", False))
    out = rotate(out, params.get("rotation", 0), w, h)
    out = scale(out, manual=params.get("manual_scale", 1.0), source=params.get("source_scale", 1.0))
    if mode == "affine":
        out = affine(out, params["affine"])
    elif mode == "bspline":
        domain = [int(params.get(k, own) / target) + 0.5 for k, own in (("target_width", w), ("target_height", h))]
        out = bspline(_whole(affine(out, params["affine"])), grid, params["intervals"], *domain, key=key)
    elif mode != "none":
        raise ValueError(f"mode: {mode!r} is neither none, affine nor bspline")
    out = scale(_whole(out) if whole_pixels else out, target=target)
    if whole_pixels:
        out = _put(out, F.col("x").cast("long").cast("double"), F.col("y").cast("long").cast("double"))
    return shift(out, params.get("shift_x", 0.0), params.get("shift_y", 0.0))
