"""Command line: python -m tempograph embed | compare | generate | recode | p-values."""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import dictionary, experiment, metrics, report, sbm
from .plans.graphs import Graph
from .sources import text


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tempograph")
    sub = top.add_subparsers(dest="command", required=True)
    embed = sub.add_parser("embed", help="an edge list to an embedding file")
    embed.add_argument("edges")
    embed.add_argument("out")
    embed.add_argument("--method", choices=sorted(experiment.METHODS), default="ULSE-n1")
    embed.add_argument("--dims", type=int, default=3)
    embed.add_argument("--bias", default="0.1", help="a number, avg or none")
    embed.add_argument("--cut-method", choices=("diff", "laplacian", "prod", "fast"), default="fast")
    embed.add_argument("--normalized", action="store_true")
    embed.add_argument("--noise", action="store_true")
    for name, kind, value in (("beta", float, 1.0), ("cost", float, 1.0), ("walk-length", int, 80), ("num-walks", int, 10), ("window", int, 10), ("p", float, 1.0), ("q", float, 1.0), ("iterations", int, 1), ("seed", int, 1)):
        embed.add_argument(f"--{name}", type=kind, default=value)
    embed.add_argument("--max-timesteps", type=int, help="bin consecutive times if there are more")
    compare = sub.add_parser("compare", help="embedding files and labels to ranked scores")
    compare.add_argument("pattern", help="embedding files, name <dataset>_<method>.emb")
    compare.add_argument("labels")
    compare.add_argument("out")
    compare.add_argument("--dataset", required=True)
    compare.add_argument("--nodes", type=int, required=True)
    compare.add_argument("--clusters", type=int, required=True)
    compare.add_argument("--starts", type=int, default=100)
    generate = sub.add_parser("generate", help="a dynamic block model's labels and edges")
    generate.add_argument("out")
    generate.add_argument("--nodes", type=int, default=200)
    generate.add_argument("--shares", type=float, nargs="+", default=[0.3, 0.4, 0.3])
    generate.add_argument("--mapping", nargs="+", default=["0:0"], help="one a time, such as 1:0,2:1")
    generate.add_argument("--p", type=float, default=0.5)
    generate.add_argument("--q", type=float, default=0.2)
    generate.add_argument("--runs", type=int, default=1)
    generate.add_argument("--seed", type=int, default=42)
    generate.add_argument("--connected", action="store_true")
    recode = sub.add_parser("recode", help="times of a day to five steps")
    recode.add_argument("edges")
    recode.add_argument("out")
    tests = sub.add_parser("p-values", help="one-tailed Welch tests of two summaries")
    for name in ("high", "low", "out"):
        tests.add_argument(name)
    tests.add_argument("--runs", type=int, default=20)
    return top


def embed(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    edges = text.read_edges(spark, a.edges)
    if a.max_timesteps:
        bins = dictionary.bin_ordinal(dictionary.time_dictionary(edges), a.max_timesteps).select("time", F.col("bin").cast("double").alias("__bin"))
        edges = edges.join(bins, "time").select("src", "dst", F.col("__bin").alias("time"))
    g = Graph(edges)
    bias = None if a.bias == "none" else a.bias if a.bias == "avg" else float(a.bias)
    keys = ("cut_method", "normalized", "noise", "beta", "cost", "walk_length", "num_walks", "window", "p", "q", "iterations", "seed")
    found = experiment.METHODS[a.method](g, a.dims, bias=bias, **{k: getattr(a, k) for k in keys})
    text.write_embeddings(experiment.named(g, found), a.out)
    return experiment.statistics(found)


def compare(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    files = text.discover_embeddings(spark, a.pattern, a.dataset).collect()  # one row a method
    parts = [text.read_embeddings(spark, r["file"]).select(F.lit(r["method"]).alias("method"), "t", F.col("node").alias("i"), "emb") for r in files]
    labels = text.read_labels(spark, a.labels, a.nodes).withColumnRenamed("node", "i")
    records = experiment.compare(reduce(DataFrame.unionByName, parts), labels, a.clusters, a.nodes, starts=a.starts).withColumn("dataset", F.lit(a.dataset))
    text.write_csv(records, f"{a.out}/records.csv")
    wide = report.pivoted(report.long_form(records, ["acc", "nmi", "ari", "f1"]), sorted(r["method"] for r in files))
    text.write_csv(wide, f"{a.out}/table.csv")
    spark.createDataFrame([(report.latex(wide, "Clustering scores", "tab:clustering"),)], "value string").coalesce(1).write.text(f"{a.out}/table.tex")
    return wide


def generate(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    mappings = [{int(x): int(y) for x, y in (pair.split(":") for pair in m.split(","))} for m in a.mapping]
    static = sbm.static_labels(spark, a.nodes, a.shares, a.seed)
    labels = sbm.relabelled(static, mappings)
    text.write_config(spark, f"{a.out}/config.txt", len(a.shares), a.shares, a.seed, mappings, a.p, a.q)
    text.write_labels(labels.withColumnRenamed("i", "node"), f"{a.out}/node2label.txt")
    prob, out = sbm.probabilities(labels, a.p, a.q), None
    for run in range(a.runs):
        edges = sbm.sampled_connected(prob, static.select("i"), a.seed + run) if a.connected else sbm.sampled(prob, a.seed + run)
        text.write_edges(edges, f"{a.out}/run{run}/edges.txt")
        count = edges.groupBy("time").agg(F.count("*").alias("edges")).withColumn("run", F.lit(run))
        out = count if out is None else out.unionByName(count)
    return out


def recode(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    found = text.recode_school(spark, a.edges)
    text.write_edges(found, a.out)
    return found.groupBy("time").count()


def p_values(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    sides = [text.read_summary(spark, p).select("metric", "pq", F.col("mean").alias(f"mean_{s}"), F.col("std").alias(f"std_{s}")) for p, s in ((a.high, "a"), (a.low, "b"))]
    found = metrics.one_tailed(metrics.welch(sides[0].join(sides[1], ["metric", "pq"]), a.runs))
    text.write_p_values(found, a.out, "high", "low")
    return found.select("metric", "pq", "p", "direction")


COMMANDS = {"embed": embed, "compare": compare, "generate": generate, "recode": recode, "p-values": p_values}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("tempograph").getOrCreate()
    return COMMANDS[a.command](spark, a)


