"""Temporal graphs made of the test tables; each has a twin in SQL (see sql)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dictionary, matrices
from ..operators.shared import written
from ..operators.spectral import Scaled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cosupply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, time): suppliers, the smaller first, that share an order, by the order's quarter; an order has few suppliers."""
    supplied = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("s"))
    by_order = supplied.groupBy("k").agg(F.sort_array(F.collect_set("s")).alias("s")).where(F.size("s") > 1)
    when = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).cast("double").alias("time"))
    first = by_order.join(when, "k").select("time", "s", F.posexplode("s").alias("at", "src"))
    return first.select("src", F.explode(F.slice("s", F.col("at") + 2, F.size("s"))).alias("dst"), "time").distinct()


def user_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, time): users and event types (from 10**9 in their order), a row an event, by day."""
    events = table(spark, sf_dir, "events")
    kinds = events.select("event_type").distinct()
    number = kinds.agg(F.sort_array(F.collect_list("event_type")).alias("kinds"))  # a handful of types
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("double")
    found = events.select(F.col("user_id").alias("src"), "event_type", day.alias("time")).join(F.broadcast(number))
    return found.select("src", (F.array_position("kinds", F.col("event_type")) + F.lit(10**9)).cast("long").alias("dst"), "time")


def nation_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, time, w): nations of customer and supplier, by year, w the number of lines; directed."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").cast("double").alias("time"))
    customers, suppliers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = lines.join(orders, "o_orderkey").join(customers, "c_custkey").join(suppliers, "s_suppkey")
    return joined.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst"), "time").agg(F.count("*").cast("double").alias("w"))


@dataclass
class Graph:
    """An edge relation with its dictionaries and matrices, each made once and written, as many operators start from them."""

    source: DataFrame

    @cached_property
    def edges(self) -> DataFrame:
        return written(self.source, "edges")

    @cached_property
    def nodes(self) -> DataFrame:
        return written(dictionary.node_dictionary(self.edges), "nodes")

    @cached_property
    def times(self) -> DataFrame:
        return written(dictionary.time_dictionary(self.edges), "times")

    @cached_property
    def indexed(self) -> DataFrame:
        return dictionary.indexed(self.edges, self.nodes, self.times)

    @cached_property
    def adjacency(self) -> DataFrame:
        return written(matrices.adjacency(self.indexed), "adjacency")

    @cached_property
    def rows(self) -> DataFrame:
        return matrices.spine(self.nodes, self.times)

    @cached_property
    def degree(self) -> DataFrame:
        return matrices.degree(self.adjacency, self.rows)

    @cached_property
    def n(self) -> int:
        return self.nodes.count()

    @cached_property
    def length(self) -> int:
        return self.times.count()

    def n1(self, bias: float | str = 0.1) -> DataFrame:
        return matrices.laplacian_n1(self.adjacency, matrices.regularised(self.degree, bias, ["t"]))

    def n2(self, bias: float | str = 0.1) -> DataFrame:
        return matrices.laplacian_n2(self.adjacency, matrices.regularised(self.degree, bias, ["t"]), matrices.degree_aggregated(self.degree, bias))

    def scaled_n1(self, bias: float | str = 0.1) -> Scaled:
        deg = matrices.regularised(self.degree, bias, ["t"])
        return Scaled(self.adjacency, deg, deg, True, lambda adj: matrices.laplacian_n1(adj, deg))

    def scaled_n2(self, bias: float | str = 0.1) -> Scaled:
        deg, total = matrices.regularised(self.degree, bias, ["t"]), matrices.degree_aggregated(self.degree, bias)
        return Scaled(self.adjacency, total, deg, False, lambda adj: matrices.laplacian_n2(adj, deg, total))
