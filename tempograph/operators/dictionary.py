"""Temporal edge lists: dictionaries of nodes and times, indexed edges, time bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamped_bin
from .order import dense_index


def node_dictionary(edges: DataFrame) -> DataFrame:
    """(node, i): the distinct ends of edges(src, dst, time) over all times, numbered from 0 in their order."""
    return dense_index(edges.select(F.explode(F.array("src", "dst")).alias("node")), "node", "i")


def time_dictionary(edges: DataFrame) -> DataFrame:
    """(time, t): the distinct times, compared exactly, numbered from 0 in their order."""
    return dense_index(edges, "time", "t")


def indexed(edges: DataFrame, nodes: DataFrame, times: DataFrame) -> DataFrame:
    """(t, src, dst) in numbers; duplicates and directions stay. Spark broadcasts the dictionaries if their measured size allows."""
    a, b = nodes.select(F.col("node").alias("src"), F.col("i").alias("__a")), nodes.select(F.col("node").alias("dst"), F.col("i").alias("__b"))
    return edges.join(times, "time").join(a, "src").join(b, "dst").select("t", F.col("__a").alias("src"), F.col("__b").alias("dst"))


def bin_ordinal(times: DataFrame, most: int) -> DataFrame:
    """(time, t, bin): runs of max(1, T div most) consecutive times share a bin; without need (T <= most) each has its own.

    The number of bins may exceed `most`, as T need not be a multiple of it.
    """
    count = times.count()
    width = max(1, count // most) if count > most else 1
    return times.withColumn("bin", F.floor(F.col("t") / width).cast("long"))


def bin_equal_width(edges: DataFrame, bins: int) -> DataFrame:
    """edges with their time's equal-width bin."""
    ends = edges.agg(F.min("time").alias("low"), F.max("time").alias("high"))
    return edges.join(F.broadcast(ends)).withColumn("bin", clamped_bin(F.col("time"), F.col("low"), F.col("high"), bins)).drop("low", "high")


def static_edges(edges: DataFrame) -> DataFrame:
    """(src, dst) without time, duplicates kept."""
    return edges.select("src", "dst")


def with_reverse(edges: DataFrame) -> DataFrame:
    """(u, v, ts, idx): both directions, exact duplicates once, numbered from 1 by time (ties by u, then v)."""
    from .order import ranged, running

    both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("time").alias("ts"))
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"), "ts")).distinct()
    return running(ranged(both, "ts"), ["ts", "u", "v"], {"idx": F.lit(1)}).select("u", "v", "ts", F.col("idx").cast("long").alias("idx"))


def missing_reverse(edges: DataFrame) -> DataFrame:
    """(src, dst, time): the reversed edges that are not there."""
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "time").distinct()
    return turned.join(edges, ["src", "dst", "time"], "left_anti")
