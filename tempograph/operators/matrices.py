"""Snapshot matrices as relations: adjacency, degrees, Laplacians, unfoldings, and figures of snapshots.

A graph is (adjacency(t, i, j, w), nodes(node, i), times(time, t)). A spine of all (t, i) gives nodes without edges
their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import inverse_root
from . import tiles


def adjacency(edges: DataFrame) -> DataFrame:
    """(t, i, j, w) of indexed edges: symmetric, each entry 1 however often an edge occurs, a self-loop once on the diagonal."""
    pairs = edges.select("t", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()  # half of the entries are shuffled
    entry = lambda i, j: F.struct(F.col(i).alias("i"), F.col(j).alias("j"))
    both = F.explode(F.when(F.col("a") == F.col("b"), F.array(entry("a", "b"))).otherwise(F.array(entry("a", "b"), entry("b", "a"))))
    return pairs.select("t", both.alias("e")).select("t", "e.i", "e.j").withColumn("w", F.lit(1.0))


def spine(nodes: DataFrame, times: DataFrame) -> DataFrame:
    """(t, i): every node at every time, as many rows as the answer has. Times are few: each node gets an array of them."""
    every = times.agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return nodes.select("i").join(F.broadcast(every)).select(F.explode("ts").alias("t"), "i")


def degree(adj: DataFrame, rows: DataFrame) -> DataFrame:
    """(t, i, deg) for every row of the spine."""
    found = adj.groupBy("t", "i").agg(F.sum("w").alias("deg"))
    return rows.join(found, ["t", "i"], "left").select("t", "i", F.coalesce("deg", F.lit(0.0)).alias("deg"))


def regularised(deg: DataFrame, bias: float | str | None, by: list[str]) -> DataFrame:
    """Degrees with a bias added: a constant, "avg" for the mean degree within `by`, or none. The bias goes into degrees only, never into entries."""
    if bias in (None, 0, False):
        return deg
    if bias == "avg":
        window = Window.partitionBy(*by) if by else None
        if window is None:
            return deg.join(F.broadcast(deg.agg(F.avg("deg").alias("__bias")))).withColumn("deg", F.col("deg") + F.col("__bias")).drop("__bias")
        return deg.withColumn("deg", F.col("deg") + F.avg("deg").over(window))
    return deg.withColumn("deg", F.col("deg") + F.lit(float(bias)))


def degree_aggregated(deg: DataFrame, bias: float | str | None = None) -> DataFrame:
    """(i, deg) over all times, the bias added once."""
    return regularised(deg.groupBy("i").agg(F.sum("deg").alias("deg")), bias, [])


def entries(adj: DataFrame, diagonal: DataFrame) -> DataFrame:
    """Sum of two relations of entries (t, i, j, val)."""
    return adj.unionByName(diagonal).groupBy("t", "i", "j").agg(F.sum("val").alias("val"))


def laplacian(adj: DataFrame, deg: DataFrame) -> DataFrame:
    """(t, i, j, val) of D - A; an entry that cancels out is 0."""
    return entries(adj.select("t", "i", "j", (-F.col("w")).alias("val")), deg.select("t", "i", F.col("i").alias("j"), F.col("deg").alias("val")))


def scaled(adj: DataFrame, left: DataFrame, left_on: list[str], right: DataFrame) -> DataFrame:
    """(t, i, j, val): entries times 1/sqrt of the row's degree in left and of the column's in right(t, i, deg)."""
    a = left.select(*left_on, inverse_root(F.col("deg")).alias("__a"))
    b = right.select("t", F.col("i").alias("j"), inverse_root(F.col("deg")).alias("__b"))
    return adj.join(a, left_on).join(b, ["t", "j"]).select("t", "i", "j", (F.col("w") * F.col("__a") * F.col("__b")).alias("val"))


def laplacian_n1(adj: DataFrame, deg: DataFrame) -> DataFrame:
    """(t, i, j, val) of I - D^-1/2 A D^-1/2; the row of a node without degree is the identity's."""
    minus = scaled(adj, deg, ["t", "i"], deg).withColumn("val", -F.col("val"))
    return entries(minus, deg.select("t", "i", F.col("i").alias("j"), F.lit(1.0).alias("val")))


def laplacian_n2(adj: DataFrame, deg: DataFrame, total: DataFrame) -> DataFrame:
    """(t, i, j, val) of -D_total^-1/2 A D_t^-1/2, which is not symmetric."""
    return scaled(adj, total, ["i"], deg).withColumn("val", -F.col("val"))


def chain_laplacian(times: DataFrame) -> DataFrame:
    """(i, j, val) of the path of times: 2 on the diagonal, 1 at the ends (also of a single time), -1 beside it."""
    last = times.agg(F.max("t").alias("last"))
    t = times.select("t").join(F.broadcast(last))
    ends = F.when((F.col("t") == 0) | (F.col("t") == F.col("last")), 1.0).otherwise(2.0)
    beside = t.where("t < last").select(F.explode(F.array(F.struct(F.col("t").alias("i"), (F.col("t") + 1).alias("j")), F.struct((F.col("t") + 1).alias("i"), F.col("t").alias("j")))).alias("e"))
    return t.select(F.col("t").alias("i"), F.col("t").alias("j"), ends.alias("val")).unionByName(beside.select("e.i", "e.j", F.lit(-1.0).alias("val")))


def unfolded(cells: DataFrame, n: Column) -> DataFrame:
    """(i, col, w): the snapshots side by side, column t * n + j."""
    return cells.select("i", (F.col("t") * n + F.col("j")).alias("col"), "w")


def edge_density(edges: DataFrame, times: DataFrame, n: int) -> DataFrame:
    """(t, density): rows of indexed edges, duplicates counted, to the number of pairs."""
    found = edges.groupBy("t").agg(F.count("*").alias("rows"))
    return times.select("t").join(found, "t", "left").select("t", (F.coalesce("rows", F.lit(0)) / (n * (n - 1) / 2 if n > 1 else float("inf"))).alias("density"))


def jaccard_change(edges: DataFrame, times: DataFrame) -> DataFrame:
    """(t, change): 1 - |common| / |union| of the distinct directed edges at t and at t + 1, for all t but the last; 0 if both are empty."""
    own = edges.select("t", "src", "dst").distinct()
    sizes = own.groupBy("t").agg(F.count("*").alias("n"))
    common = own.join(own.withColumn("t", F.col("t") - 1), ["t", "src", "dst"], "left_semi").groupBy("t").agg(F.count("*").alias("common"))
    after = sizes.select((F.col("t") - 1).alias("t"), F.col("n").alias("m"))
    steps = times.select("t").join(times.select((F.col("t") - 1).alias("t")), "t", "left_semi")
    joined = steps.join(sizes, "t", "left").join(after, "t", "left").join(common, "t", "left").fillna(0)
    union = F.col("n") + F.col("m") - F.col("common")
    return joined.select("t", F.when(union > 0, 1 - F.col("common") / union).otherwise(0.0).alias("change"))


def beta_suggestion(density: DataFrame, change: DataFrame, n: int, steps: int) -> DataFrame:
    """(beta): a swap cost that grows with density and size, and falls with change and length; from 0.1 to 10."""
    figures = density.agg(F.avg("density").alias("d")).join(F.broadcast(change.agg(F.coalesce(F.avg("change"), F.lit(0.0)).alias("c"))))
    raw = (1 + 2 * F.col("d")) * (1 - F.col("c") / 2) * (n**0.5 / 10) / steps**0.5
    return figures.select(F.greatest(F.lit(0.1), F.least(F.lit(10.0), raw)).alias("beta"))


def isolated(adj: DataFrame, rows: DataFrame) -> DataFrame:
    """(t, i): nodes without an edge, at the times that have any."""
    held = rows.join(adj.select("t").distinct(), "t", "left_semi")
    return held.join(adj.select("t", "i").distinct(), ["t", "i"], "left_anti")


def volumes(deg: DataFrame) -> DataFrame:
    """(t, volume, n_active): a snapshot's total degree, and its nodes with any."""
    return deg.groupBy("t").agg(F.sum("deg").alias("volume"), F.sum((F.col("deg") > 0).cast("long")).alias("n_active"))


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """(i, j, val) of the product of two sparse matrices (i, j, val)."""
    return tiles.product(left.select(F.col("i").alias("x"), F.col("j").alias("k"), F.col("val").alias("v")), right.select(F.col("j").alias("x"), F.col("i").alias("k"), F.col("val").alias("v")))
