"""Comparison reports: rankings, pivots with marks, summaries, LaTeX."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIRST = ("ULSE-n1", "ULSE-n2", "UASE")


def method_order(method: str = "method") -> list:
    """Named methods first, in their order, then the others by name."""
    rank = reduce(lambda c, k: c.when(F.col(method) == FIRST[k], k), range(len(FIRST)), F.when(F.lit(False), 0)).otherwise(len(FIRST))
    return [rank, F.col(method)]


def best_second(scores: DataFrame) -> DataFrame:
    """(dataset, metric, method, value, place): place 1 and 2 by value; of equal values the method that comes first is ahead."""
    order = Window.partitionBy("dataset", "metric").orderBy(F.desc("value"), *method_order())
    return scores.withColumn("place", F.row_number().over(order).cast("long")).where("place <= 2")


def long_form(records: DataFrame, metrics: list[str]) -> DataFrame:
    """(dataset, method, metric, value) of records with a column for each metric."""
    return records.select("dataset", "method", F.explode(F.array(*[F.struct(F.upper(F.lit(m)).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("e")).select("dataset", "method", "e.metric", "e.value")


def pivoted(scores: DataFrame, methods: list[str]) -> DataFrame:
    """(dataset, metric, a column for each method): values with four digits, **best**, __second__, N/A for none."""
    place = best_second(scores).select("dataset", "metric", "method", "place")
    shown = F.format_string("%.4f", "value")
    marked = F.when(F.col("place") == 1, F.concat(F.lit("**"), shown, F.lit("**"))).when(F.col("place") == 2, F.concat(F.lit("__"), shown, F.lit("__"))).otherwise(shown)
    cells = scores.join(place, ["dataset", "metric", "method"], "left").select("dataset", "metric", "method", marked.alias("cell"))
    wide = cells.groupBy("dataset", "metric").pivot("method", methods).agg(F.first("cell"))
    return wide.select("dataset", "metric", *[F.coalesce(f"`{m}`", F.lit("N/A")).alias(m) for m in methods])


def summary(records: DataFrame, metrics: list[str]) -> DataFrame:
    """(method, a mean for each metric, datasets): over the datasets."""
    return records.groupBy("method").agg(*[F.avg(m).alias(m) for m in metrics], F.countDistinct("dataset").alias("datasets"))


def best_by(records: DataFrame, metric: str) -> DataFrame:
    """(dataset, method): the best method of each dataset; of equals the first in order."""
    order = Window.partitionBy("dataset").orderBy(F.desc(metric), *method_order())
    return records.withColumn("__k", F.row_number().over(order)).where("__k = 1").select("dataset", "method", metric)


def availability(found: DataFrame, rows: DataFrame) -> DataFrame:
    """(method, n_available, completion): what share of the spine each method of found(method, t, i) has."""
    total = rows.agg(F.count("*").alias("__n"))
    own = found.select("method", "t", "i").distinct().groupBy("method").agg(F.count("*").alias("n_available"))
    return own.join(F.broadcast(total)).select("method", "n_available", (F.col("n_available") / F.col("__n")).alias("completion"))


def frame_limits(points: DataFrame, margin: float = 0.05) -> DataFrame:
    """points(t, i, x, y, ...) with limits that all times share: the extremes and a margin of their range."""
    ends = points.agg(*[f(c).alias(f"{c}_{n}") for c in ("x", "y") for f, n in ((F.min, "min"), (F.max, "max"))])
    wide = lambda c: (F.col(f"{c}_max") - F.col(f"{c}_min")) * margin
    return ends.select(*[(F.col(f"{c}_{n}") + s * wide(c)).alias(f"{c}_{n}") for c in ("x", "y") for n, s in (("min", -1), ("max", 1))])


def latex(table: DataFrame, caption: str, label: str) -> str:
    """A table of a report's size (a row a dataset and metric) as LaTeX; **x** is bold, __x__ underlined."""
    def cell(x: str) -> str:
        x = x.replace("_", r"\_") if not x.startswith("__") else x
        return rf"\textbf{{{x[2:-2]}}}" if x.startswith("**") else rf"\underline{{{x[2:-2]}}}" if x.startswith("__") else x

    names = [c.replace("_", r"\_") for c in table.columns]
    rows = [" & ".join(cell(str(x)) for x in r) + r" \\" for r in table.orderBy(*table.columns[:2]).collect()]
    return "\n".join([r"\begin{table}[t]", r"\centering", rf"\caption{{{caption}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{'l' * len(names)}}}", r"\toprule", " & ".join(names) + r" \\", r"\midrule", *rows, r"\bottomrule", r"\end{tabular}", r"\end{table}"])
