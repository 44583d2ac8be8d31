"""Dynamic stochastic block models: labels, probabilities and sampled edges.

Draws are hashes of (seed, node) or (seed, t, i, j), so that a draw does not depend on partitions or retries, and
equal seeds give common random numbers to different probabilities.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import matrices


def uniform(seed: int | Column, *keys: Column) -> Column:
    """A number from [0, 1) by the keys' hash."""
    return F.pmod(F.shiftrightunsigned(F.xxhash64(F.lit(seed) if isinstance(seed, int) else seed, *keys), 11), F.lit(2**53)) / F.lit(float(2**53))


def static_labels(spark: SparkSession, n: int, shares: list[float], seed: int) -> DataFrame:
    """(i, label): n nodes, labels drawn by their shares."""
    ends = list(accumulate(shares))
    x = uniform(seed, F.col("i"))
    label = F.lit(len(shares) - 1)
    for k in range(len(shares) - 2, -1, -1):
        label = F.when(x < ends[k], k).otherwise(label)
    return spark.range(n).withColumnRenamed("id", "i").withColumn("label", label.cast("long"))


def relabelled(static: DataFrame, mappings: list[dict[int, int]]) -> DataFrame:
    """(t, i, label): each time's mapping of the static labels; a label without one stays."""
    each = F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.create_map(*[F.lit(x).cast("long") for p in m.items() for x in p]).alias("m") if m else F.lit(None).cast("map<bigint,bigint>").alias("m")) for t, m in enumerate(mappings)])
    rows = static.withColumn("e", F.explode(each))
    return rows.select("e.t", "i", F.coalesce(F.try_element_at("e.m", "label"), "label").alias("label"))


#: Nodes of a block of labels: block pairs are what is shuffled, and their pairs of nodes are made where they are read.
BLOCK = 512


def probabilities(labels: DataFrame, p: float, q: float) -> DataFrame:
    """(t, i, j, prob) for j <= i: p within a label, q between. labels(t, i, label), i numbered from 0 without gaps.

    The rows are the answer's own, and are neither joined nor shuffled: each time's labels travel as arrays of BLOCK nodes, a
    pair of arrays for BLOCK * BLOCK rows, and a pair's rows are made from its arrays, node by node.
    """
    parts = max(int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * labels.sparkSession.sparkContext.defaultParallelism)
    blocks = labels.groupBy("t", F.floor(F.col("i") / BLOCK).alias("b")).agg(F.sort_array(F.collect_list(F.struct("i", "label"))).alias("x"))
    left, right = blocks.select("t", F.col("b").alias("__a"), F.col("x.label").alias("__x")), blocks.select("t", "b", F.col("x.label").alias("__y"))
    pairs = left.join(right, "t").where("b <= __a").repartition(parts, "t", "__a", "b")
    rows = pairs.select("t", "__a", "b", F.posexplode("__x").alias("__k", "label"), "__y").select("t", (F.col("__a") * BLOCK + F.col("__k")).alias("i"), "label", (F.col("b") * BLOCK).alias("__from"), F.when(F.col("__a") == F.col("b"), F.slice("__y", 1, F.col("__k") + 1)).otherwise(F.col("__y")).alias("__y"))
    # coalesce moves nothing: it ends a compiled stage, which else holds all rows that one row gave, a pair's BLOCK * BLOCK
    every = rows.coalesce(parts).select("t", "i", "__from", "label", F.posexplode("__y").alias("__j", "__other"))
    return every.select("t", "i", (F.col("__from") + F.col("__j")).alias("j"), F.when(F.col("label") == F.col("__other"), p).otherwise(q).alias("prob"))


def sampled(prob: DataFrame, seed: int) -> DataFrame:
    """(src, dst, time): an edge wherever the draw is below prob; times from 1, self-loops included."""
    return prob.where(uniform(seed, F.col("t"), F.col("i"), F.col("j")) < F.col("prob")).select(F.col("i").alias("src"), F.col("j").alias("dst"), (F.col("t") + 1).cast("double").alias("time"))


def sampled_connected(prob: DataFrame, nodes: DataFrame, seed: int, tries: int = 10) -> DataFrame:
    """A sample without isolated nodes at times that have edges: the first of seeds seed, seed + 1, ...; the last if none is."""
    for k in range(tries):
        edges = sampled(prob, seed + k)
        adj = matrices.adjacency(edges.select(F.col("time").cast("long").alias("t"), "src", "dst"))
        if matrices.isolated(adj, matrices.spine(nodes, adj.select("t").distinct())).isEmpty():
            break
    return edges
