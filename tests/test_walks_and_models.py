from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphs import random_edges, relation
from tempograph.operators import matrices, sbm, walks
from tempograph.plans.graphs import Graph


@pytest.fixture
def weighted(spark):
    g = Graph(relation(spark, [(0, 1, 0.0), (1, 2, 0.0), (0, 2, 0.0), (2, 3, 0.0), (4, 5, 1.0)]))
    return g, g.adjacency


def test_first_order(spark, weighted):
    found = walks.first_order(weighted[1]).groupBy("t", "i").agg(F.sum("p").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in found)


def test_second_order(spark, weighted):
    found = {(r["i"], r["j"], r["k"]): r["prob"] for r in walks.second_order(weighted[1], 0.5, 2.0).where("t = 0").collect()}
    # from 0 to 2: back to 0 weighs 2, on to 1 (a neighbour of 0) weighs 1, on to 3 weighs 1/2
    assert [found[0, 2, k] for k in (0, 1, 3)] == pytest.approx([2 / 3.5, 1 / 3.5, 0.5 / 3.5])


def test_walks_follow_edges_and_repeat(spark, weighted):
    g, adj = weighted
    edges = {(r["t"], r["i"], r["j"]) for r in adj.collect()}
    first, again = (sorted((r["t"], tuple(r["path"])) for r in walks.walks(adj, g.rows, 3, 5, 0.5, 2.0, seed=4).collect()) for _ in range(2))
    assert first == again and len(first) == 2 * 6 * 3
    alone = [p for t, p in first if len(p) == 1]
    assert len(alone) == 3 * (2 + 4)
    for t, path in first:
        assert all((t, a, b) in edges for a, b in zip(path, path[1:], strict=False)) and len(path) in (1, 5)


def test_walk_frequencies(spark, weighted):
    g, adj = weighted
    found = walks.walks(adj.where("t = 0"), g.rows.where("t = 0 and i = 0"), 600, 3, 0.5, 2.0)
    counts = Counter(tuple(r["path"][1:3]) for r in found.collect())
    after = {k: n for (j, k), n in counts.items() if j == 2}
    total = sum(after.values())
    for k, p in ((0, 2 / 3.5), (1, 1 / 3.5), (3, 0.5 / 3.5)):
        assert abs(after.get(k, 0) / total - p) < 4 * np.sqrt(p * (1 - p) / total)


def test_skip_gram_covers_the_spine(spark, weighted):
    g, adj = weighted
    found = walks.skip_gram(walks.walks(adj, g.rows, 2, 4, 1.0, 1.0), g.rows, 4).collect()
    assert len(found) == 12 and all(len(r["emb"]) == 4 for r in found)


def test_label_sampling(spark):
    labels = sbm.static_labels(spark, 3000, [0.3, 0.4, 0.3], 42)
    counts = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    for k, p in enumerate((0.3, 0.4, 0.3)):
        assert abs(counts[k] - 3000 * p) < 4 * np.sqrt(3000 * p * (1 - p))
    assert labels.exceptAll(sbm.static_labels(spark, 3000, [0.3, 0.4, 0.3], 42)).isEmpty()


def test_relabelling_keeps_labels_without_mapping(spark):
    static = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "i long, label long")
    found = {(r["t"], r["i"]): r["label"] for r in sbm.relabelled(static, [{}, {1: 0, 2: 1}]).collect()}
    assert found == {(0, 0): 0, (0, 1): 1, (0, 2): 2, (1, 0): 0, (1, 1): 0, (1, 2): 1}


def test_sampled_edges(spark):
    labels = sbm.relabelled(sbm.static_labels(spark, 120, [0.5, 0.5], 1), [{0: 0}, {1: 0}])
    prob = sbm.probabilities(labels, 0.5, 0.2)
    assert prob.count() == 2 * 120 * 121 // 2 and prob.where("j > i").isEmpty()
    edges = sbm.sampled(prob, 7)
    assert edges.select("time").distinct().count() == 2 and edges.agg(F.min("time")).first()[0] == 1.0
    rate = prob.join(edges.select((F.col("time") - 1).cast("long").alias("t"), F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1).alias("hit")), ["t", "i", "j"], "left").groupBy("prob").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("rate"), F.count("*").alias("n"))
    for r in rate.collect():
        assert abs(r["rate"] - r["prob"]) < 4 * np.sqrt(r["prob"] * (1 - r["prob"]) / r["n"])
    denser = sbm.sampled(sbm.probabilities(labels, 0.6, 0.3), 7)
    assert edges.exceptAll(denser).isEmpty()  # common random numbers


def test_connected_sample(spark):
    labels = sbm.relabelled(sbm.static_labels(spark, 12, [1.0], 1), [{}])
    nodes = labels.select("i")
    found = sbm.sampled_connected(sbm.probabilities(labels, 0.4, 0.4), nodes, 1)
    adj = matrices.adjacency(found.select(F.col("time").cast("long").alias("t"), "src", "dst"))
    assert matrices.isolated(adj, matrices.spine(nodes, adj.select("t").distinct())).isEmpty()


def test_communities_are_recovered(spark):
    from tempograph.operators import cluster, metrics, spectral

    labels = sbm.relabelled(sbm.static_labels(spark, 80, [0.5, 0.5], 3), [{}, {}])
    g = Graph(sbm.sampled(sbm.probabilities(labels, 0.8, 0.1), 5))
    found = cluster.per_time(spectral.ulse_n1(g.n1(), g.nodes, g.rows, g.n, 2, g.length), 2)
    score = metrics.nmi(metrics.contingency(found.join(labels, ["t", "i"]), ["t"]), ["t"]).agg(F.min("nmi")).first()[0]
    assert score > 0.95
    assert random_edges(1)


def test_probabilities_are_made_after_the_last_shuffle(spark):
    """Three blocks of labels: every pair once, and nothing but pairs of blocks is joined or shuffled."""
    n = 2 * sbm.BLOCK + 70
    labels = sbm.relabelled(sbm.static_labels(spark, n, [0.5, 0.5], 3), [{}, {1: 0}])
    prob = sbm.probabilities(labels, 0.5, 0.2)
    plan = prob._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("posexplode") < plan.index("Exchange") and plan.rindex("posexplode") < plan.index("Join")
    kind = {(r["t"], r["i"]): r["label"] for r in labels.collect()}
    found = prob.toPandas()
    assert len(found) == 2 * n * (n + 1) // 2 and not found.duplicated(["t", "i", "j"]).any()
    assert (found["j"] <= found["i"]).all() and found["j"].min() == 0 and found["i"].max() == n - 1
    few = found.sample(5000, random_state=1)
    assert all(p == (0.5 if kind[t, i] == kind[t, j] else 0.2) for t, i, j, p in zip(few["t"], few["i"], few["j"], few["prob"], strict=True))


def test_rows_of_a_pair_of_blocks_are_not_all_held_at_once(spark):
    """The two steps that make a pair's rows are compiled apart, so that one node's rows are held at once; before, all BLOCK * BLOCK were."""
    labels = sbm.relabelled(sbm.static_labels(spark, 700, [0.5, 0.5], 3), [{}])
    plan = sbm.sampled(sbm.probabilities(labels, 0.5, 0.2), 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("Coalesce") < plan.rindex("Generate posexplode")
