"""Columns that several operators need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inverse_root(x: Column) -> Column:
    """1 / sqrt(x), and 0 where x is not positive: an isolated node has no weight rather than an infinite one."""
    return F.when(x > 0, 1 / F.sqrt(x)).otherwise(F.lit(0.0))


def guarded_inverse_root(x: float, least: float = 1e-10) -> float:
    """1 / sqrt(x) of a singular value, 0 if it is `least` or smaller."""
    return x**-0.5 if x > least else 0.0


def recoded_time(t: Column) -> Column:
    """Fifths of a school day: [0, .2) is 1, ..., [.6, .8) is 4, from .8 on 5; negative, null and NaN are 0."""
    return F.when(F.isnan(t) | t.isNull() | (t < 0), 0).when(t < 0.2, 1).when(t < 0.4, 2).when(t < 0.6, 3).when(t < 0.8, 4).otherwise(5).cast("long")


def clamped_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Number of the equal-width bin from 0; the highest value is in the last bin, and a range without width is bin 0."""
    return F.when(high > low, F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1))).otherwise(0).cast("long")


def pairs(n: Column) -> Column:
    """Number of unordered pairs among n."""
    return n * (n - 1) / 2


def no_minus_zero(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits) + F.lit(0.0)
