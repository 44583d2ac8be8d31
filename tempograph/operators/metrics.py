"""Scores of a clustering against labels, for each group of rows, from contingency tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import pairs
from ..functions.statistics import assignment, student_two_tailed


def contingency(rows: DataFrame, by: list[str], label: str = "label", cluster: str = "cluster") -> DataFrame:
    """(by, label, cluster, n): rows of each pair; rows with a null in either are left out."""
    found = rows.where(F.col(label).isNotNull() & F.col(cluster).isNotNull())
    return found.groupBy(*by, F.col(label).alias("label"), F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"))


def margins(table: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    a = table.groupBy(*by, "label").agg(F.sum("n").alias("a"))
    b = table.groupBy(*by, "cluster").agg(F.sum("n").alias("b"))
    return a, b, table.groupBy(*by).agg(F.sum("n").alias("total"))


def with_key(table: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    return (table, by) if by else (table.withColumn("__all", F.lit(1)), ["__all"])


def entropy(counts: DataFrame, by: list[str], n: str, total: DataFrame, name: str) -> DataFrame:
    share = F.col(n) / F.col("total")
    return counts.join(total, by).groupBy(*by).agg((-F.sum(share * F.log(share))).alias(name))


def nmi(table: DataFrame, by: list[str]) -> DataFrame:
    """(by, nmi): mutual information over the mean of both entropies; 1 if each side is one class."""
    table, keys = with_key(table, by)
    a, b, total = margins(table, keys)
    share = F.col("n") / F.col("total")
    mutual = table.join(a, [*keys, "label"]).join(b, [*keys, "cluster"]).join(total, keys).groupBy(*keys).agg(F.sum(share * F.log(F.col("n") * F.col("total") / (F.col("a") * F.col("b")))).alias("mutual"))
    both = mutual.join(entropy(a, keys, "a", total, "ha"), keys).join(entropy(b, keys, "b", total, "hb"), keys)
    mean = (F.col("ha") + F.col("hb")) / 2
    return both.select(*by, F.when(mean > 0, F.greatest(F.lit(0.0), F.col("mutual")) / mean).otherwise(1.0).alias("nmi"))


def ari(table: DataFrame, by: list[str]) -> DataFrame:
    """(by, ari): pairs that both sides keep together, adjusted for chance; 1 where there is nothing to adjust."""
    table, keys = with_key(table, by)
    a, b, total = margins(table, keys)
    together = table.groupBy(*keys).agg(F.sum(pairs(F.col("n"))).alias("s"))
    sa, sb = a.groupBy(*keys).agg(F.sum(pairs(F.col("a"))).alias("sa")), b.groupBy(*keys).agg(F.sum(pairs(F.col("b"))).alias("sb"))
    all_ = pairs(F.col("total"))
    expected = F.when(all_ > 0, F.col("sa") * F.col("sb") / all_).otherwise(0.0)
    most = (F.col("sa") + F.col("sb")) / 2
    joined = together.join(sa, keys).join(sb, keys).join(total, keys)
    return joined.select(*by, F.when(most == expected, 1.0).otherwise((F.col("s") - expected) / (most - expected)).alias("ari"))


def matched(table: DataFrame, by: list[str]) -> DataFrame:
    """(by, acc, f1): accuracy and macro F1 after clusters get labels one to one so that most rows agree.

    A group's table, classes by classes, is solved in one task. More clusters than labels, or fewer, leave some
    without a partner; a cluster without one predicts a class of its own, which counts in no label's favour.
    """
    table, keys = with_key(table, by)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        grid = rows.pivot_table(index="label", columns="cluster", values="n", fill_value=0, aggfunc="sum")
        size = max(grid.shape)
        gain = np.zeros((size, size))
        gain[: grid.shape[0], : grid.shape[1]] = grid.to_numpy()
        to = assignment(gain)
        hit = gain[np.arange(size), to][: grid.shape[0]]
        true = gain.sum(1)[: grid.shape[0]]
        told = gain.sum(0)[to[: grid.shape[0]]]
        f1 = np.where(true + told > 0, 2 * hit / np.maximum(true + told, 1), 0.0)
        return pd.DataFrame({**{k: [rows[k].iloc[0]] for k in keys}, "acc": [hit.sum() / gain.sum()], "f1": [f1.mean()]})

    kinds = dict(table.dtypes)
    return table.groupBy(*keys).applyInPandas(solve, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", acc double, f1 double").select(*by, "acc", "f1")


def f1_macro(table: DataFrame, by: list[str]) -> DataFrame:
    """(by, f1): unweighted mean over all classes of either side, the cluster's number being the label it tells; a class never met has 0."""
    table, keys = with_key(table, by)
    a, b, _ = margins(table, keys)
    classes = a.select(*keys, F.col("label").alias("c")).union(b.select(*keys, F.col("cluster").alias("c"))).distinct()
    hit = table.where("label = cluster").select(*keys, F.col("label").alias("c"), F.col("n").alias("hit"))
    found = classes.join(a.withColumnRenamed("label", "c"), [*keys, "c"], "left").join(b.withColumnRenamed("cluster", "c"), [*keys, "c"], "left").join(hit, [*keys, "c"], "left").fillna(0, ["a", "b", "hit"])
    return found.groupBy(*keys).agg(F.avg(2 * F.col("hit") / (F.col("a") + F.col("b"))).alias("f1")).select(*by, "f1")


def evaluable(embedding: DataFrame, labels: DataFrame, available: DataFrame | None = None, below: int | None = None) -> DataFrame:
    """Rows with an embedding, a label, an id below a bound, and, at times that `available` (t, i) knows, in it; times with one label only go."""
    rows = embedding.join(labels, ["t", "i"])
    if below is not None:
        rows = rows.where(F.col("i") < below)
    if available is not None:
        rows = semi_available(rows, available)
    enough = rows.groupBy("t").agg(F.countDistinct("label").alias("k")).where("k >= 2").select("t")
    return rows.join(enough, "t", "left_semi")


def semi_available(rows: DataFrame, available: DataFrame) -> DataFrame:
    """Rows that `available` (t, i) has, and all rows of times that it does not know."""
    known = available.select("t").distinct().withColumn("__known", F.lit(True))
    here = available.select("t", "i").distinct().withColumn("__here", F.lit(True))
    joined = rows.join(known, "t", "left").join(here, ["t", "i"], "left")
    return joined.where("__known is null or __here").drop("__known", "__here")


def common_available(found: DataFrame) -> DataFrame:
    """(t, i) that every method of found(method, t, i) has; a method without a time empties that time."""
    methods = found.agg(F.countDistinct("method").alias("__n"))
    return found.groupBy("t", "i").agg(F.countDistinct("method").alias("__m")).join(F.broadcast(methods)).where("__m = __n").select("t", "i")


def label_count_average(rows: DataFrame) -> DataFrame:
    """(label_count): the mean over times with at least two rows of their number of labels."""
    return rows.groupBy("t").agg(F.countDistinct("label").alias("k"), F.count("*").alias("n")).where("n >= 2").agg(F.avg("k").alias("label_count"))


def welch(joined: DataFrame, n: int) -> DataFrame:
    """joined(mean_a, std_a, mean_b, std_b, ...) with welch_t, welch_df and direction. Both null if neither side varies."""
    va, vb = F.col("std_a") ** 2 / n, F.col("std_b") ** 2 / n
    both: Column = va + vb
    t = F.when(both > 0, (F.col("mean_a") - F.col("mean_b")) / F.sqrt(both))
    df = F.when(both > 0, both**2 / (va**2 / (n - 1) + vb**2 / (n - 1)))
    return joined.withColumns({"welch_t": t, "welch_df": df, "direction": F.when(F.col("mean_a") > F.col("mean_b"), ">").otherwise("<")})


def one_tailed(joined: DataFrame) -> DataFrame:
    """With p: half the two-tailed probability of welch_t, whichever way it points; null without one."""

    @F.pandas_udf("double")
    def half(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) else student_two_tailed(a, b) / 2 for a, b in zip(t, df, strict=True)], dtype="float64")

    return joined.withColumn("p", half("welch_t", "welch_df"))


def mean_embedding(vectors: DataFrame, by: list[str]) -> DataFrame:
    """(by, emb): the mean of an array column, component by component, null for none."""
    part = vectors.select(*by, F.posexplode("emb").alias("k", "x")).groupBy(*by, "k").agg(F.avg("x").alias("x"))
    return part.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]).alias("emb"))
