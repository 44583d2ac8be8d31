"""Ranks and running sums over a whole relation without gathering it in one task.

Rows are dealt into ranges of the leading key, whose bounds come from a sketch of quantiles; windows run inside a
range, and what lies before a range is added from the ranges' totals, a few numbers each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written

RANGE = "__range"


def ranged(df: DataFrame, key: str, ranges: int | None = None) -> DataFrame:
    """df with a column that grows with `key` (a number): the range that the key is in."""
    ranges = ranges or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = [k / ranges for k in range(1, ranges)]
    bounds = sorted(set(df.approxQuantile(key, shares, 0.5 / ranges))) if shares else []
    over = F.array(*[F.lit(b) for b in bounds]) if bounds else None
    return df.withColumn(RANGE, F.size(F.filter(over, lambda b: b < F.col(key).cast("double"))) if bounds else F.lit(0))


def running(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """A ranged df with running totals, the row itself included, in the order of `order`, whose first column made the ranges.

    Totals of nothing and of nulls are 0.
    """
    own = Window.partitionBy(RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = df.groupBy(RANGE).agg(*[F.sum(c).alias(n) for n, c in sums.items()]).collect()  # one row a range
    before: dict[str, dict[int, float]] = {n: {} for n in sums}
    so_far = dict.fromkeys(sums, 0)
    for row in sorted(totals, key=lambda r: r[RANGE]):
        for n in sums:
            before[n][row[RANGE]] = so_far[n]
            so_far[n] += row[n] or 0
    out = df
    for n, c in sums.items():
        base = F.create_map(*[F.lit(x) for pair in before[n].items() for x in pair])[F.col(RANGE)] if before[n] else F.lit(0)
        out = out.withColumn(n, F.coalesce(F.sum(c).over(own), F.lit(0)) + base)
    return out


def dense_index(keys: DataFrame, key: str, index: str) -> DataFrame:
    """(key, index): distinct keys numbered from 0 in their order."""
    found = ranged(written(keys.select(key).where(F.col(key).isNotNull()).distinct(), "keys"), key)
    return running(found, [key], {index: F.lit(1)}).select(key, (F.col(index) - 1).cast("long").alias(index))
