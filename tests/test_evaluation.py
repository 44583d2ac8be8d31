from itertools import permutations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tempograph.functions.statistics import assignment, incomplete_beta, student_two_tailed
from tempograph.operators import cluster, metrics, report


def rows_of(spark, pairs):
    return spark.createDataFrame([(0, n, a, b) for n, (a, b) in enumerate(pairs)], "t long, i long, label long, cluster long")


def plain(pairs):
    """NMI and ARI by pair counting and plain sums."""
    n = len(pairs)
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    share = lambda x, c: x.count(c) / n
    h = lambda x: -sum(share(x, c) * np.log(share(x, c)) for c in set(x))
    mutual = sum(pairs.count(p) / n * np.log(pairs.count(p) / n / share(a, p[0]) / share(b, p[1])) for p in set(pairs))
    nmi = 1.0 if h(a) + h(b) == 0 else max(0, mutual) / ((h(a) + h(b)) / 2)
    two = lambda x: x * (x - 1) / 2
    s, sa, sb = (sum(two(x.count(c)) for c in set(x)) for x in (pairs, a, b))
    expected = sa * sb / two(n) if n > 1 else 0
    ari = 1.0 if (sa + sb) / 2 == expected else (s - expected) / ((sa + sb) / 2 - expected)
    return nmi, ari


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=30))
def test_nmi_and_ari(spark, pairs):
    table = metrics.contingency(rows_of(spark, pairs), ["t"])
    nmi, ari = plain(pairs)
    assert metrics.nmi(table, ["t"]).first()["nmi"] == pytest.approx(nmi, abs=1e-9)
    assert metrics.ari(table, ["t"]).first()["ari"] == pytest.approx(ari, abs=1e-9)


@given(st.integers(1, 6).flatmap(lambda n: st.lists(st.lists(st.integers(0, 20), min_size=n, max_size=n), min_size=n, max_size=n)))
def test_assignment_is_the_best(grid):
    gain = np.array(grid, float)
    to = assignment(gain)
    assert sorted(to) == list(range(len(grid)))
    assert gain[np.arange(len(grid)), to].sum() == max(sum(gain[i, p[i]] for i in range(len(grid))) for p in permutations(range(len(grid))))


def test_accuracy_and_f1_after_matching(spark):
    found = metrics.matched(metrics.contingency(rows_of(spark, [(0, 2), (0, 2), (1, 0), (1, 0), (1, 2), (2, 1)]), ["t"]), ["t"]).first()
    assert found["acc"] == pytest.approx(5 / 6)
    assert found["f1"] == pytest.approx((2 * 2 / 5 + 2 * 2 / 5 + 1) / 3)


def test_f1_without_matching(spark):
    found = metrics.f1_macro(metrics.contingency(rows_of(spark, [(0, 0), (0, 1), (1, 1), (2, 1)]), ["t"]), ["t"]).first()["f1"]
    assert found == pytest.approx((2 / 3 + 1 / 2 + 0) / 3)


def test_student(spark):
    assert incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)
    assert student_two_tailed(0.0, 5.0) == pytest.approx(1.0)
    assert student_two_tailed(2.5706, 5.0) == pytest.approx(0.05, abs=1e-5)
    rows = [("NMI", "p", 0.4446, 0.0766, 0.3591, 0.0723), ("NMI", "q", 1.0, 0.0, 1.0, 0.0)]
    joined = spark.createDataFrame(rows, "metric string, pq string, mean_a double, std_a double, mean_b double, std_b double")
    found = {r["pq"]: r for r in metrics.one_tailed(metrics.welch(joined, 20)).collect()}
    assert found["p"]["p"] == pytest.approx(4.16e-4, rel=1e-2) and found["p"]["direction"] == ">"
    assert found["q"]["p"] is None and found["q"]["direction"] == "<"


def test_availability(spark):
    found = spark.createDataFrame([("a", 0, 1), ("b", 0, 1), ("a", 0, 2), ("a", 1, 1)], "method string, t long, i long")
    assert [tuple(r) for r in metrics.common_available(found).collect()] == [(0, 1)]
    kept = metrics.semi_available(found, metrics.common_available(found))
    assert sorted((r["method"], r["t"], r["i"]) for r in kept.collect()) == [("a", 0, 1), ("a", 1, 1), ("b", 0, 1)]
    share = {r["method"]: r["completion"] for r in report.availability(found, found.select("t", "i").distinct()).collect()}
    assert share == {"a": 1.0, "b": pytest.approx(1 / 3)}


def test_evaluable_rows(spark):
    emb = spark.createDataFrame([(t, i, [float(i)]) for t in (0, 1) for i in range(4)], "t long, i long, emb array<double>")
    labels = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 3, 2), (1, 0, 1), (1, 1, 1)], "t long, i long, label long")
    assert sorted((r["t"], r["i"]) for r in metrics.evaluable(emb, labels, below=3).collect()) == [(0, 0), (0, 1)]


def test_kmeans_finds_separate_groups(spark):
    draw = np.random.default_rng(0)
    rows = [(t, i, (np.array([10.0 * (i % 3), 0.0]) + draw.normal(0, 0.1, 2)).tolist()) for t in range(2) for i in range(30)]
    found = cluster.per_time(spark.createDataFrame(rows, "t long, i long, emb array<double>"), {0: 3, 1: 2}).toPandas()
    assert found[found.t == 0].groupby(found.i % 3).cluster.nunique().tolist() == [1, 1, 1]
    assert found[found.t == 0].cluster.nunique() == 3 and found[found.t == 1].cluster.nunique() == 2


def test_mean_embedding(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 6.0]), (2, [5.0, 5.0])], "g long, emb array<double>")
    assert {r["g"]: r["emb"] for r in metrics.mean_embedding(df, ["g"]).collect()} == {1: [2.0, 4.0], 2: [5.0, 5.0]}


def scores(spark):
    return spark.createDataFrame([("d", "ACC", "x", 0.9967), ("d", "ACC", "y", 0.9967), ("d", "ACC", "UASE", 1.0), ("e", "ACC", "x", 0.5)], "dataset string, metric string, method string, value double")


def test_ranking_and_pivot(spark):
    places = {(r["dataset"], r["method"]): r["place"] for r in report.best_second(scores(spark)).collect()}
    assert places == {("d", "UASE"): 1, ("d", "x"): 2, ("e", "x"): 1}
    wide = report.pivoted(scores(spark), ["UASE", "x", "y"])
    rows = {r["dataset"]: r for r in wide.collect()}
    assert (rows["d"]["UASE"], rows["d"]["x"], rows["d"]["y"]) == ("**1.0000**", "__0.9967__", "0.9967")
    assert rows["e"]["UASE"] == "N/A" and rows["e"]["x"] == "**0.5000**"
    tex = report.latex(wide, "Scores", "tab:s")
    assert r"\textbf{1.0000}" in tex and r"\underline{0.9967}" in tex and "N/A" in tex


def test_summaries(spark):
    records = spark.createDataFrame([("d", "x", 1.0, 0.5), ("e", "x", 0.0, 0.5), ("d", "y", 0.2, 0.1)], "dataset string, method string, acc double, nmi double")
    assert {r["method"]: (r["acc"], r["datasets"]) for r in report.summary(records, ["acc", "nmi"]).collect()} == {"x": (0.5, 2), "y": (0.2, 1)}
    assert {r["dataset"]: r["method"] for r in report.best_by(records, "acc").collect()} == {"d": "x", "e": "x"}
    assert report.long_form(records, ["acc", "nmi"]).where(F.col("metric") == "NMI").count() == 3


def test_frame_limits(spark):
    points = spark.createDataFrame([(0, 0.0, -1.0), (1, 10.0, 1.0)], "t long, x double, y double")
    assert tuple(report.frame_limits(points).first()) == (-0.5, 10.5, -1.1, 1.1)
