"""Scalar functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """c held between lo and hi; null stays null."""
    return F.when(c < lo, F.lit(lo)).when(c > hi, F.lit(hi)).otherwise(c)


def finite(c: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def nulled(c: Column) -> Column:
    """c with NaN and infinities as null."""
    return F.when(finite(c.cast("double")), c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def edges(bins: int) -> list[float]:
    """The bins + 1 edges of equal-width bins on [0, 1]."""
    return [i / bins for i in range(bins + 1)]


def floor_bin(p: Column, bins: int) -> Column:
    """Number of edges <= p, less one: left-closed bins, so 1.0 gets the id `bins`, outside all bins."""
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges(bins)]), lambda e: e <= p)) - 1


def closed_bin(p: Column, bins: int) -> Column:
    """Left-closed bins of which the last holds 1.0 too."""
    return F.least(floor_bin(p, bins), F.lit(bins - 1))


def quantile_bin(p: Column, cuts: Column) -> Column:
    """Right-closed bin of p among an array of cuts that starts with 0 and ends with 1, held to the valid ids."""
    n = F.size(F.filter(cuts, lambda e: e < p)) - 1
    return F.greatest(F.lit(0), F.least(n, F.size(cuts) - 2))
