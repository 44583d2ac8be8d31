import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphs import dense, embedding, random_edges, relation, snapshots
from tempograph.operators import cuts, eigen, spectral
from tempograph.operators.eigen import NotConverged
from tempograph.plans.graphs import Graph


def laplacians(a, bias=0.1):
    d = a.sum(2) + bias
    return np.eye(a.shape[1]) - a / np.sqrt(d[:, :, None] * d[:, None, :])


def second(a, bias=0.1):
    d, total = a.sum(2) + bias, a.sum((0, 2)) + bias
    return -a / np.sqrt(total[None, :, None] * d[:, None, :])


def by_svd(cells, d, kind):
    """The embedding from the whole singular value decomposition of the unfolded matrix."""
    length, n, _ = cells.shape
    u, s, vt = np.linalg.svd(np.hstack(cells), full_matrices=False)
    inverse = np.where(s > 1e-10, 1 / np.sqrt(np.maximum(s, 1e-300)), 0)
    y = vt.T * np.sqrt(s)
    if kind == "n1":
        y = (y - np.tile(u * inverse, (length, 1)))[:, n - d - 1 : n - 1]
    else:
        y = y[:, :d]
    return y.reshape(length, n, d)


def assert_same_up_to_signs(x, y):
    x, y = x.reshape(-1, x.shape[2]), y.reshape(-1, y.shape[2])
    np.testing.assert_allclose(x * np.sign((x * y).sum(0)), y, atol=1e-6)


@pytest.fixture(params=[1, 2])
def case(request, spark):
    edges = random_edges(request.param, n=12, length=3)
    return Graph(relation(spark, edges)), snapshots(edges)


def test_uase(case):
    g, a = case
    assert_same_up_to_signs(embedding(spectral.uase(g.adjacency, g.nodes, g.rows, g.n, 3), (3, 12, 3)), by_svd(a, 3, "uase"))


def test_ulse_n1(case):
    g, a = case
    assert_same_up_to_signs(embedding(spectral.ulse_n1(g.n1(), g.nodes, g.rows, g.n, 3, g.length), (3, 12, 3)), by_svd(laplacians(a), 3, "n1"))


def test_ulse_n2(case):
    g, a = case
    assert_same_up_to_signs(embedding(spectral.ulse_n2(g.n2(), g.nodes, g.rows, g.n, 3), (3, 12, 3)), by_svd(second(a), 3, "n2"))


def test_gram_forms_agree(case):
    g, a = case
    cells = g.n1()
    upper = dense(spectral.gram(cells), (12, 12), ("i", "j"))
    l = laplacians(a)  # noqa: E741
    whole = sum(x @ x.T for x in l)
    np.testing.assert_allclose(upper, np.triu(whole), atol=1e-12)
    np.testing.assert_allclose(spectral.gram_dense(cells, 12), whole, atol=1e-12)


def test_subspace_iteration_finds_the_same_space(spark, monkeypatch):
    edges = random_edges(3, n=14, length=3)
    g, a = Graph(relation(spark, edges)), snapshots(edges)
    cells = g.adjacency.select("t", "i", "j", F.col("w").alias("val"))
    sigma, x = spectral.subspace(cells, g.nodes, 2, 12, 5, False, 0.0)
    s = np.linalg.svd(np.hstack(a), compute_uv=False)
    np.testing.assert_allclose(sigma[:1], s[:1], rtol=1e-5)
    monkeypatch.setattr(spectral, "DENSE", 2)
    found = embedding(spectral.uase(g.adjacency, g.nodes, g.rows, g.n, 1), (3, 14, 1))
    assert_same_up_to_signs(found, by_svd(a, 1, "uase"))


def test_omni_is_the_greatest_triplets(case):
    g, a = case
    found = embedding(spectral.omni(g.adjacency, g.rows, g.n, 3), (3, 12, 3))
    values = sorted((abs(v) for x in a for v in np.linalg.eigvalsh(x)), reverse=True)[:3]
    np.testing.assert_allclose((found**2).sum((0, 1)), values, atol=1e-9)
    assert all(np.count_nonzero(np.abs(found[:, :, c]).sum(1) > 1e-12) == 1 for c in range(3))


def test_nodes_without_edges_have_rows(spark):
    g = Graph(relation(spark, [(0, 1, 0.0), (1, 2, 0.0), (2, 3, 1.0), (0, 3, 1.0)]))
    found = spectral.uase(g.adjacency, g.nodes, g.rows, g.n, 2)
    assert found.count() == 8 and found.where(F.size("emb") != 2).count() == 0


def test_iterated_smallest_vectors_are_those_of_the_whole_problem(spark, monkeypatch):
    """Several hundred nodes in four groups: the same vectors with and without DENSE."""
    draw, group = np.random.default_rng(4), np.repeat(range(4), [30, 48, 60, 102])
    edges = [(i, j, float(t)) for t in range(2) for i in range(240) for j in range(i + 1, 240) if draw.random() < (0.3 if group[i] == group[j] else 0.01) or j == i + 1]
    g = Graph(relation(spark, edges))
    vectors = lambda: np.stack(spectral.left_vectors(g.n1(), g.nodes, g.n, 3, True, bound=8.0).toPandas().sort_values("i")["u"])
    expected = vectors()
    monkeypatch.setattr(spectral, "DENSE", 2)
    np.testing.assert_allclose(vectors(), expected, atol=1e-6)


def test_too_few_rounds_are_an_error(spark):
    g = Graph(relation(spark, random_edges(11, n=60, length=2, share=0.1)))
    with pytest.raises(NotConverged):
        spectral.subspace(g.n1(), g.nodes, 3, 1, 5, True, 8.0)


@pytest.mark.parametrize("smallest", [False, True])
def test_few_pairs_of_a_sparse_snapshot_are_those_of_the_dense_one(monkeypatch, smallest):
    """300 nodes in three groups of their own density: values, residuals and spaces with the dense way switched off."""
    draw, group = np.random.default_rng(8), np.repeat(range(3), 100)
    x = np.triu(draw.random((300, 300)) < np.where(group[:, None] == group, 0.3, 0.02) * (1 + group / 4), 1).astype(float)
    x += x.T
    if smallest:
        x = np.diag(x.sum(1)) - x
    i, j = np.nonzero(x)
    cells = pd.DataFrame({"i": i, "j": j, "val": x[i, j]})
    expected, u = eigen.few_pairs(cells, 300, 3, smallest)
    monkeypatch.setattr(eigen, "DENSE_SNAPSHOT", 1)
    found, v = eigen.few_pairs(cells, 300, 3, smallest)
    np.testing.assert_allclose(found, expected, rtol=1e-6, atol=1e-6)
    np.testing.assert_allclose(spectral.canonical(v), spectral.canonical(u), atol=1e-6)
    assert np.abs(x @ v - v * found).max() < 1e-5


def test_omni_and_fast_cuts_without_dense_snapshots(spark, monkeypatch):
    g = Graph(relation(spark, random_edges(12, n=40, length=3, share=0.2)))
    both = lambda: (embedding(spectral.omni(g.adjacency, g.rows, g.n, 3), (3, 40, 3)), dense(cuts.fast_vector(g.adjacency, g.rows, 40, 3, rank=4), (3, 40), ("t", "i"), "ev"))
    a, b = both()

    def sparse_pairs(cells, n, wanted, smallest=False):  # in workers, which know nothing of this module
        from tempograph.operators import eigen as own

        before, own.DENSE_SNAPSHOT = own.DENSE_SNAPSHOT, 1
        try:
            return own.few_pairs(cells, n, wanted, smallest)
        finally:
            own.DENSE_SNAPSHOT = before

    monkeypatch.setattr(spectral, "few_pairs", sparse_pairs)
    monkeypatch.setattr(cuts, "few_pairs", sparse_pairs)
    c, d = both()
    np.testing.assert_allclose(c, a, atol=1e-6)
    np.testing.assert_allclose(np.abs(d), np.abs(b), atol=1e-5)


def test_a_snapshot_that_is_too_large_is_an_error(spark, monkeypatch):
    g = Graph(relation(spark, random_edges(13, n=10, length=2)))
    monkeypatch.setattr(eigen, "ENTRIES", 3)
    with pytest.raises(ValueError, match="entries"):
        spectral.omni(g.adjacency, g.rows, g.n, 2)


def test_iterations_send_vectors_to_packed_cells(spark, monkeypatch):
    """Beyond DENSE nodes and up to LOCAL no round joins relations (before, each did); beyond LOCAL the vectors are the same."""
    edges = random_edges(7, n=20, length=3)
    g, a = Graph(relation(spark, edges)), snapshots(edges)
    monkeypatch.setattr(spectral, "DENSE", 2)
    found = lambda: embedding(spectral.uase(g.adjacency, g.nodes, g.rows, g.n, 1), (3, 20, 1))
    with monkeypatch.context() as patch:
        patch.setattr(spectral, "Relations", None)
        local = found()
        cells = g.n1()
        x = np.random.default_rng(1).standard_normal((20, 3))
        l = laplacians(a)  # noqa: E741
        np.testing.assert_allclose(spectral.gram_product(spectral.pieces(cells, 50), 20)(x), sum(s @ (s.T @ x) for s in l), atol=1e-10)
    assert_same_up_to_signs(local, by_svd(a, 1, "uase"))
    monkeypatch.setattr(spectral, "LOCAL", 0)
    assert_same_up_to_signs(found(), local)


@pytest.mark.parametrize("name", ["ulse_n1", "ulse_n2"])
def test_embeddings_by_components_are_those_of_the_whole(spark, monkeypatch, name):
    """Beyond the dense size a graph of several components is solved by them, without iteration."""
    edges = random_edges(11, n=8, length=3) + [(i + 20, j + 20, t) for i, j, t in random_edges(12, n=6, length=3)] + [(i + 40, j + 40, t) for i, j, t in random_edges(13, n=5, length=2)]
    g = Graph(relation(spark, edges))

    def found():
        if name == "ulse_n1":
            return embedding(spectral.ulse_n1(g.n1(), g.nodes, g.rows, g.n, 3, g.length, g.scaled_n1()), (g.length, g.n, 3))
        return embedding(spectral.ulse_n2(g.n2(), g.nodes, g.rows, g.n, 3, g.scaled_n2(), g.length), (g.length, g.n, 3))

    whole = found()
    monkeypatch.setattr(spectral, "DENSE", 4)
    monkeypatch.setattr(spectral, "subspace", None)
    np.testing.assert_allclose(found(), whole, atol=1e-8)
