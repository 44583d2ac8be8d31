import numpy as np
import pytest
from pyspark.sql import functions as F

from graphs import dense, embedding, random_edges, relation, snapshots
from tempograph.operators import cuts, eigen
from tempograph.operators.spectral import canonical
from tempograph.plans.graphs import Graph


def brute(a, order, normalized, cost=1.0):
    """(edges, swaps, balance) of each prefix of (t, i) pairs."""
    length, n, _ = a.shape
    inside, out = np.zeros((length, n), bool), []
    for t, i in order:
        inside[t, i] = True
        cut = sum(a[s, j, k] for s in range(length) for j in range(n) for k in range(n) if j != k and inside[s, j] and not inside[s, k])
        swaps = cost * sum(inside[s, j] != inside[s + 1, j] for s in range(length - 1) for j in range(n))
        if normalized:
            d = a.sum(2)
            balance = sum(d[s][inside[s]].sum() * (d[s].sum() - d[s][inside[s]].sum()) for s in range(length))
        else:
            balance = sum(inside[s].sum() * (n - inside[s].sum()) for s in range(length))
        out.append((cut, swaps, balance))
    return out


@pytest.fixture(params=[4, 5])
def case(request, spark):
    edges = random_edges(request.param, n=7, length=3)
    return Graph(relation(spark, [*edges, (0, 0, 0.0)])), snapshots(edges), np.random.default_rng(request.param)


def scored(spark, draw, length, n):
    values = draw.integers(0, 5, (length, n)).astype(float)
    rows = [(t, i, float(values[t, i])) for t in range(length) for i in range(n)]
    return spark.createDataFrame(rows, "t long, i long, ev double"), [(t, i) for _, t, i in sorted((v, t, i) for t, i, v in rows)]


@pytest.mark.parametrize("normalized", [False, True])
@pytest.mark.parametrize("every", [1, 3])
def test_sweep_against_brute_force(spark, case, normalized, every):
    g, a, draw = case
    if normalized:
        g.adjacency = g.adjacency.where("i <> j")
    scores, order = scored(spark, draw, 3, 7)
    found = cuts.sweep(scores, g.adjacency, 7, 2, normalized=normalized, every=every)
    expected = brute(a, order[::every], normalized)
    got = [(r["edges"], r["swaps"], r["balance"]) for r in found.orderBy("r").collect()]
    np.testing.assert_allclose(got, expected, atol=1e-9)
    best = cuts.best_cut(found).first()
    ratios = [(e + s) / b if b > 0 else np.inf for e, s, b in expected]
    assert best["r"] == int(np.argmin(np.round(ratios, 12))) + 1
    assert cuts.sides(found, g.rows).where("side = -1").count() == best["r"]


def supra(a, cost=1.0):
    length, n, _ = a.shape
    out = np.zeros((length * n, length * n))
    for t, x in enumerate(a):
        out[t * n : t * n + n, t * n : t * n + n] += np.diag(x.sum(1)) - x
    for t in range(length - 1):
        for i in range(n):
            p, q = t * n + i, (t + 1) * n + i
            out[p, p] += cost
            out[q, q] += cost
            out[p, q] -= cost
            out[q, p] -= cost
    return out


def test_supra_laplacian(spark, case):
    g, a, _ = case
    a = a.copy()
    a[0, 0, 0] = 1
    np.testing.assert_allclose(dense(cuts.supra_laplacian(g.adjacency, g.rows, g.times, 7), (21, 21), ("row", "col")), supra(a), atol=1e-12)


def test_complete_laplacian_is_applied(spark, case):
    g, _, _ = case
    x = dense(g.degree, (3, 7), ("t", "i"), "deg")
    found = dense(cuts.complete_apply(g.degree.withColumnRenamed("deg", "x"), 7), (3, 7), ("t", "i"), "x")
    np.testing.assert_allclose(found, x @ (7 * np.eye(7) - np.ones((7, 7))))


@pytest.mark.parametrize("method", ["diff", "laplacian", "prod"])
def test_vectors_dense_and_by_power_method(spark, case, method):
    g, a, _ = case
    a = a.copy()
    a[0, 0, 0] = 1
    l, c = supra(a), np.kron(np.eye(3), 7 * np.eye(7) - np.ones((7, 7)))  # noqa: E741
    m = {"diff": 27.0 * c - l, "laplacian": -l, "prod": c @ l @ c}[method]
    values, vectors = np.linalg.eigh(m)
    expected = canonical(vectors[:, ::-1][:, 1 if method == "laplacian" else 0 :][:, :1])[:, 0]
    found = dense(cuts.vector(method, g.adjacency, g.rows, g.times, 7, 3), (3, 7), ("t", "i"), "ev").reshape(-1)
    np.testing.assert_allclose(found, expected, atol=1e-8)
    if method == "prod":
        powered = dense(cuts.vector(method, g.adjacency, g.rows, g.times, 7, 3, dense=1), (3, 7), ("t", "i"), "ev").reshape(-1)
        assert powered @ m @ powered == pytest.approx(values[-1], rel=1e-2)


@pytest.mark.parametrize("method", ["diff", "laplacian", "prod"])
@pytest.mark.parametrize("local", [0, 4_000_000])
def test_iterated_vectors_are_those_of_the_whole_problem(spark, method, local):
    g = Graph(relation(spark, random_edges(6, n=12, length=4)))
    vector = lambda dense: embedding(cuts.vector(method, g.adjacency, g.rows, g.times, 12, 4, dense=dense, local=local).withColumn("emb", F.array("ev")), (4, 12, 1)).reshape(-1)
    whole, found = vector(4096), vector(1)
    assert abs(whole @ found) == pytest.approx(1, abs=1e-8)


def test_fast_vector_solves_the_whole_small_problem(spark, case):
    g, a, _ = case
    a = a.copy()
    a[0, 0, 0] = 1
    r, beta, n = 6, 1.0, 7
    c = 3.0 * (n + 2 * beta) * n
    m = np.zeros((3 * r, 3 * r))
    for t, x in enumerate(a):
        lam = np.linalg.eigvalsh(np.diag(x.sum(1)) - x)[:r]
        m[t * r : t * r + r, t * r : t * r + r] = np.diag(np.r_[0, c - lam[1:]])
    for t in range(2):
        for i in range(r):
            p, q = t * r + i, (t + 1) * r + i
            for x, y in ((p, q), (q, p), (p, p), (q, q)):
                m[x, y] -= beta
    found = dense(cuts.fast_vector(g.adjacency, g.rows, n, 3), (3, 7), ("t", "i"), "ev")
    weights = np.linalg.norm(found, axis=1)
    top = np.linalg.eigh(m)[1][:, -1].reshape(3, r)
    np.testing.assert_allclose(weights, np.linalg.norm(top, axis=1), atol=1e-6)
    with pytest.raises(ValueError):
        cuts.vector("other", g.adjacency, g.rows, g.times, 7, 3)


def test_widened(spark, case):
    g, _, _ = case
    found = cuts.widened(g.degree.withColumnRenamed("deg", "ev"), 3).collect()
    assert all(len(r["emb"]) == 3 for r in found)


def apart(seed):
    """Edges of three components, one of them a pair, and of nodes that some times lack."""
    edges = random_edges(seed, n=6, length=3)
    return edges + [(i + 10, j + 10, t) for i, j, t in random_edges(seed + 1, n=5, length=3)] + [(20, 21, 1.0)]


@pytest.mark.parametrize("method", ["diff", "laplacian", "prod"])
@pytest.mark.parametrize("dims", [1, 2])
def test_vectors_of_components(spark, method, dims, monkeypatch):
    """Beyond the dense size a graph of several components is solved by them, neither collected nor iterated as a whole."""
    g, n, length = Graph(relation(spark, apart(3))), 13, 3
    l, c = supra(snapshots(apart(3))), np.kron(np.eye(3), n * np.eye(n) - np.ones((n, n)))  # noqa: E741
    m = {"diff": 3 * (n + 2.0) * c - l, "laplacian": -l, "prod": c @ l @ c}[method]
    monkeypatch.setattr(cuts, "Relations", None)
    monkeypatch.setattr(cuts, "supra_laplacian", lambda *a: g.adjacency)
    found = cuts.vector(method, g.adjacency, g.rows, g.times, n, length, dense=1, dims=dims)
    u = np.stack([dense(found.where(F.col("dim") == k) if dims > 1 else found, (length, n), ("t", "i"), "ev").reshape(-1) for k in range(dims)], 1)
    assert found.count() == dims * n * length
    np.testing.assert_allclose(u.T @ u, np.eye(dims), atol=1e-8)
    skip = 1 if method == "laplacian" else 0
    values = np.linalg.eigvalsh(m)[::-1][skip : skip + dims]
    np.testing.assert_allclose(np.diag(u.T @ m @ u), values, atol=1e-6, rtol=1e-9)
    np.testing.assert_allclose(m @ u, u * values, atol=1e-5)
    if method == "laplacian":
        np.testing.assert_allclose(u.sum(0), 0, atol=1e-9)


def test_second_smallest_vector_tells_components_apart(spark):
    """cut_laplacian's vector beyond the dense size: of value 0, equal at all times and on a component, orthogonal to the constant."""
    g = Graph(relation(spark, apart(5)))
    u = dense(cuts.vector("laplacian", g.adjacency, g.rows, g.times, 13, 3, dense=1, local=0), (3, 13), ("t", "i"), "ev")
    assert (u == u[0]).all() and len(np.unique(u[0])) == 3
    np.testing.assert_allclose([u.sum(), (u * u).sum(), np.ptp(u[0][:6]), np.ptp(u[0][6:11])], [0, 1, 0, 0], atol=1e-9)


@pytest.mark.parametrize("normalized", [False, True])
@pytest.mark.parametrize("wanted", [2, 9])
@pytest.mark.parametrize("at_once", [1, 1024])
def test_smallest_pairs_are_found_by_components(normalized, wanted, at_once, monkeypatch):
    monkeypatch.setattr(eigen, "DENSE_SNAPSHOT", at_once)
    a = snapshots([*apart(7), (5, 5, 0.0)])[0]
    i, j = np.nonzero(a)
    values, u = eigen.smallest_pairs(i, j, a[i, j], len(a), wanted, normalized)
    deg = a.sum(1)
    r = np.divide(1, np.sqrt(deg), out=np.zeros(len(a)), where=deg > 0)
    l = np.eye(len(a)) - r[:, None] * a * r if normalized else np.diag(deg) - a  # noqa: E741
    np.testing.assert_allclose(values, np.linalg.eigvalsh(l)[:wanted], atol=1e-8)
    np.testing.assert_allclose(u.T @ u, np.eye(wanted), atol=1e-8)
    np.testing.assert_allclose(l @ u, u * values, atol=1e-7)
    first = np.sqrt(deg) if normalized else np.ones(len(a))
    np.testing.assert_allclose(u[:, 0], first / np.linalg.norm(first), atol=1e-12)


def test_greatest_vector_between_components(spark):
    """cut_prod's vector where no component has a link of its own: it differs between components and alternates in time."""
    edges = [(i, i, float(t)) for t in range(3) for i in range(3)]
    g, c = Graph(relation(spark, edges)), np.kron(np.eye(3), 3 * np.eye(3) - np.ones((3, 3)))
    u = dense(cuts.vector("prod", g.adjacency, g.rows, g.times, 3, 3, dense=1), (3, 3), ("t", "i"), "ev").reshape(-1)
    m = c @ supra(np.zeros((3, 3, 3))) @ c
    np.testing.assert_allclose(m @ u, u * np.linalg.eigvalsh(m)[-1], atol=1e-9)
    assert u @ u == pytest.approx(1)


@pytest.mark.parametrize("method", ["diff", "laplacian", "prod"])
@pytest.mark.parametrize("dims", [1, 3])
def test_vectors_of_a_connected_graph_leave_its_entries_packed(spark, method, dims, monkeypatch):
    """Beyond the dense size neither the supra-Laplacian is made nor are relations iterated; the last time has one edge, so that many values lie close together."""
    n, length = 14, 4
    edges = [e for e in random_edges(21, n=n, length=length, share=0.3) if e[2] < 3] + [(0, 1, 3.0)]
    g = Graph(relation(spark, edges))
    l, c = supra(snapshots(edges)), np.kron(np.eye(length), n * np.eye(n) - np.ones((n, n)))  # noqa: E741
    m = {"diff": 3 * (n + 2.0) * c - l, "laplacian": -l, "prod": c @ l @ c}[method]
    monkeypatch.setattr(cuts, "greatest", None)
    monkeypatch.setattr(cuts, "supra_laplacian", lambda *a: g.adjacency)
    monkeypatch.setattr(cuts, "PART", 20)
    found = cuts.vector(method, g.adjacency, g.rows, g.times, n, length, dense=1, dims=dims)
    u = np.stack([dense(found.where(F.col("dim") == k) if dims > 1 else found, (length, n), ("t", "i"), "ev").reshape(-1) for k in range(dims)], 1)
    skip = 1 if method == "laplacian" else 0
    values = np.linalg.eigvalsh(m)[::-1][skip : skip + dims]
    np.testing.assert_allclose(u.T @ u, np.eye(dims), atol=1e-7)
    np.testing.assert_allclose(m @ u, u * values, atol=1e-3 if method == "prod" else 1e-5)


@pytest.mark.parametrize("normalized", [False, True])
def test_fast_vector_needs_two_pairs_of_a_snapshot(spark, monkeypatch, normalized):
    """Pairs beyond the second never give the weights: they are not asked for, and the vector is that of the whole problem."""
    a = snapshots(random_edges(31, n=10, length=3))
    g = Graph(relation(spark, random_edges(31, n=10, length=3)))
    r, c = 8, 3.0 * 12 * 10
    roots = [np.divide(1, np.sqrt(x.sum(1)), out=np.zeros(10), where=x.sum(1) > 0) for x in a]
    lam, u = zip(*(np.linalg.eigh(np.eye(10) - s[:, None] * x * s if normalized else np.diag(x.sum(1)) - x) for x, s in zip(a, roots, strict=True)), strict=True)
    chain = np.array([[1.0, 1, 0], [1, 2, 1], [0, 1, 1]])
    tops = [np.linalg.eigh(np.diag([c - x[k] for x in lam]) - chain) for k in range(1, r)]
    assert int(np.argmax([values[-1] for values, _ in tops])) == 0
    expected = np.abs(tops[0][1][:, -1:] * np.stack([x[:, 1] for x in u]))

    def two(cells, n, wanted, smallest=False):
        from tempograph.operators import eigen as own

        assert wanted <= 2
        return own.few_pairs(cells, n, wanted, smallest)

    monkeypatch.setattr(cuts, "few_pairs", two)
    found = dense(cuts.fast_vector(g.adjacency, g.rows, 10, 3, normalized=normalized), (3, 10), ("t", "i"), "ev")
    np.testing.assert_allclose(np.abs(found), expected, atol=1e-8)
