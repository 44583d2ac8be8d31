import numpy as np
import pytest
from pyspark.sql import functions as F

from graphs import TOY, dense, random_edges, relation, snapshots, toy
from tempograph.operators import dictionary, matrices
from tempograph.plans.graphs import Graph


def test_dictionaries_and_indexed_edges(spark):
    g = toy(spark)
    assert sorted(map(tuple, g.nodes.collect())) == [(10, 0), (20, 1), (30, 2), (40, 3), (50, 4)]
    assert sorted(map(tuple, g.times.collect())) == [(0.0, 0), (0.5, 1), (2.0, 2)]
    assert sorted(map(tuple, g.indexed.collect())) == [(0, 0, 1), (0, 0, 1), (0, 1, 0), (0, 1, 2), (1, 2, 2), (1, 3, 4), (2, 0, 4), (2, 1, 3)]


def test_adjacency_is_binary_and_symmetric(spark):
    g = toy(spark)
    a = dense(g.adjacency, (3, 5, 5), value="w")
    np.testing.assert_array_equal(a, snapshots(TOY))
    assert a[1, 2, 2] == 1


def test_degrees_with_each_bias(spark):
    g, a = toy(spark), snapshots(TOY)
    as_array = lambda df: dense(df, (3, 5), ("t", "i"), "deg")
    d = a.sum(2)
    np.testing.assert_allclose(as_array(g.degree), d)
    np.testing.assert_allclose(as_array(matrices.regularised(g.degree, 0.1, ["t"])), d + 0.1)
    np.testing.assert_allclose(as_array(matrices.regularised(g.degree, "avg", ["t"])), d + d.mean(1, keepdims=True))
    np.testing.assert_allclose(as_array(matrices.regularised(g.degree, None, ["t"])), d)
    total = d.sum(0)
    for bias, more in ((None, 0), (0.1, 0.1), ("avg", total.mean())):
        np.testing.assert_allclose(dense(matrices.degree_aggregated(g.degree, bias), (5,), ("i",), "deg"), total + more)


@pytest.mark.parametrize("bias", [0.1, "avg", None])
def test_laplacians(spark, bias):
    g, a = toy(spark), snapshots(TOY)
    d = a.sum(2)
    d = d + (0 if bias is None else d.mean(1, keepdims=True) if bias == "avg" else bias)
    with np.errstate(divide="ignore"):
        r = np.where(d > 0, 1 / np.sqrt(d), 0)
    np.testing.assert_allclose(dense(g.n1(bias), a.shape), np.eye(5) - a * r[:, :, None] * r[:, None, :], atol=1e-12)
    total = a.sum((0, 2))
    total = total + (0 if bias is None else total.mean() if bias == "avg" else bias)
    np.testing.assert_allclose(dense(g.n2(bias), a.shape), -a / np.sqrt(total)[None, :, None] * r[:, None, :], atol=1e-12)
    np.testing.assert_allclose(dense(matrices.laplacian(g.adjacency, g.degree), a.shape), np.array([np.diag(x.sum(1)) - x for x in a]))


def test_chain_laplacian_of_one_time(spark):
    one = spark.createDataFrame([(0.0, 0)], "time double, t long")
    assert [tuple(r) for r in matrices.chain_laplacian(one).collect()] == [(0, 0, 1.0)]
    np.testing.assert_allclose(dense(matrices.chain_laplacian(toy(spark).times), (3, 3), ("i", "j")), [[1, -1, 0], [-1, 2, -1], [0, -1, 1]])


def test_snapshot_figures(spark):
    g = toy(spark)
    density = {r["t"]: r["density"] for r in matrices.edge_density(g.indexed, g.times, g.n).collect()}
    assert density == {0: 0.4, 1: 0.2, 2: 0.2}
    change = {r["t"]: r["change"] for r in matrices.jaccard_change(g.indexed, g.times).collect()}
    assert change == {0: 1.0, 1: 1.0}
    assert sorted(map(tuple, matrices.isolated(g.adjacency, g.rows).collect())) == [(0, 3), (0, 4), (1, 0), (1, 1), (2, 2)]
    beta = matrices.beta_suggestion(matrices.edge_density(g.indexed, g.times, g.n), matrices.jaccard_change(g.indexed, g.times), 5, 3).first()["beta"]
    assert beta == pytest.approx(max(0.1, (1 + 2 * 0.8 / 3) * 0.5 * 5**0.5 / 10 / 3**0.5))


def test_product(spark):
    edges = random_edges(1)
    g, a = Graph(relation(spark, edges)), snapshots(edges)
    one, two = (g.adjacency.where(F.col("t") == t).select("i", "j", F.col("w").alias("val")) for t in (0, 1))
    np.testing.assert_allclose(dense(matrices.product(one, two), a[0].shape, ("i", "j")), a[0] @ a[1])


def test_bins(spark):
    times = spark.createDataFrame([(float(t), t) for t in range(25)], "time double, t long")
    assert [r["bin"] for r in dictionary.bin_ordinal(times, 10).orderBy("t").collect()] == [t // 2 for t in range(25)]
    assert [r["bin"] for r in dictionary.bin_ordinal(times, 30).orderBy("t").collect()] == list(range(25))
    edges = relation(spark, [(0, 1, t) for t in (0.0, 1.0, 5.0, 9.9, 10.0)])
    assert [r["bin"] for r in dictionary.bin_equal_width(edges, 5).orderBy("time").collect()] == [0, 0, 2, 4, 4]
    assert [r["bin"] for r in dictionary.bin_equal_width(relation(spark, [(0, 1, 3.0)]), 5).collect()] == [0]


def test_reversed_edges(spark):
    edges = relation(spark, [(1, 2, 0.0), (2, 1, 0.0), (1, 2, 0.0), (3, 4, 1.0)])
    assert [tuple(r) for r in dictionary.with_reverse(edges).orderBy("idx").collect()] == [(1, 2, 0.0, 1), (2, 1, 0.0, 2), (3, 4, 1.0, 3), (4, 3, 1.0, 4)]
    assert [tuple(r) for r in dictionary.missing_reverse(edges).collect()] == [(4, 3, 1.0)]


def test_empty_graph(spark):
    g = Graph(relation(spark, []))
    assert g.n == 0 and g.length == 0
    assert g.adjacency.count() == 0 and g.degree.count() == 0 and g.n1().count() == 0
