"""Exact quantiles: brackets from mergeable sketches, exact counts within them."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

_ACCURACY, _FEW, _STEPS = 10_000, 4096, 500


def _values(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")


def _merged(brackets: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for low, high in sorted(brackets):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _zones(brackets: list[tuple[float, float]]) -> tuple[Column, Column]:
    """How many brackets end below x, and whether x lies within the next one."""
    x = F.col("x")
    zone = sum((F.when(x > high, 1).otherwise(0) for _, high in brackets), F.lit(0))
    inside = F.lit(False)
    for low, high in brackets:
        inside = inside | x.between(low, high)
    return zone, inside


def _within(x: DataFrame, ranks: list[int], brackets: list[tuple[float, float]], rows: float) -> dict[int, float]:
    """Values at the ranks, which the brackets hold; about ``rows`` values, but for repeated ones, lie in a bracket."""
    brackets = _merged(brackets)
    zone, inside = _zones(brackets)
    while rows > _FEW:  # narrower brackets by sketches within these
        grid = [k / _STEPS for k in range(_STEPS + 1)]
        seen = x.groupBy(zone.alias("zone"), inside.alias("inside")).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("x", grid, _ACCURACY).alias("at")).collect()
        before, narrow, most = 0, [], 0.0
        for r in sorted(seen, key=lambda r: (r["zone"], r["inside"])):
            slack = 2 / _ACCURACY
            for rank in ranks:
                if r["inside"] and before <= rank < before + r["n"]:
                    p = (rank - before + 0.5) / r["n"]
                    low, high = max(0, math.floor((p - slack) * _STEPS)), min(_STEPS, math.ceil((p + slack) * _STEPS))
                    narrow.append((r["at"][low], r["at"][high]))
                    most = max(most, (high - low) * r["n"] / _STEPS + 2 * slack * r["n"])
            before += r["n"]
        if most >= rows:
            break
        brackets, rows = _merged(narrow), most
        zone, inside = _zones(brackets)
    bound = 64 * _FEW * len(brackets)
    counts = x.groupBy(zone.alias("zone"), F.when(inside, F.col("x")).alias("x")).agg(F.count(F.lit(1)).alias("n")).limit(bound + 1).collect()
    if len(counts) > bound:
        raise RuntimeError("the brackets of a quantile hold too many values")
    out, before, starts, values = {}, 0, [], []
    for r in sorted(counts, key=lambda r: (r["zone"], r["x"] is not None, r["x"] or 0.0)):
        starts.append(before)
        values.append(r["x"])
        before += r["n"]
    for rank in ranks:
        out[rank] = values[bisect_right(starts, rank) - 1]
    if None in out.values():  # a rank just outside of its bracket
        return _within(x, ranks, [(-math.inf, math.inf)], before)
    return out


def _sketched(x: DataFrame, shares: list[float]) -> tuple[int, list[tuple[float, float]]]:
    """Number of values, and values around each share of them, by one pass."""
    slack = 2 / _ACCURACY
    at = [min(1.0, max(0.0, s + d)) for s in shares for d in (-slack, slack)]
    row = x.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("x", at, _ACCURACY).alias("at")).first()
    ends = row["at"] or []
    return row["n"], list(zip(ends[::2], ends[1::2]))


def at_ranks(df: DataFrame, column: str, ranks: Sequence[int], n: int | None = None) -> list[float]:
    """The values at the given ranks (from 0) of the column's values in order; ``n``, their number, if it is known.

    Nulls and NaN are left out; infinities are values like others. One pass
    sketches brackets for all ranks at once, one counts the values before and
    within them exactly; very many values take further sketches within the
    brackets. No more than some thousand distinct values for each rank come to
    the driver; sketches merge, so no task holds more either.
    """
    x = _values(df, column)
    n = x.count() if n is None else n
    wanted = sorted(set(ranks))
    if not wanted:
        return []
    if not 0 <= wanted[0] <= wanted[-1] < n:
        raise IndexError(f"ranks {wanted[0]} to {wanted[-1]} of {n} values")
    _, brackets = _sketched(x, [(r + 0.5) / n for r in wanted])
    found = _within(x, wanted, brackets, 4 * n / _ACCURACY + 2)
    return [found[r] for r in ranks]


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Exact quantiles, linear between neighbouring values; null without values. Nulls and NaN are left out."""
    x = _values(df, column)
    n, brackets = _sketched(x, [float(s) for s in shares])
    if not n:
        return [None] * len(shares)
    places = [s * (n - 1) for s in shares]
    brackets = brackets if n > _FEW else [(-math.inf, math.inf)]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    found = _within(x, ranks, brackets, 4 * n / _ACCURACY + 2 if n > _FEW else n)
    ends = [(p, found[math.floor(p)], found[math.ceil(p)]) for p in places]
    return [a if a == b else a + (b - a) * (p - math.floor(p)) for p, a, b in ends]
