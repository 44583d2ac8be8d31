import numpy as np
import pytest
from pyspark.sql import functions as F

from graphs import random_edges, relation
from tempograph import cli
from tempograph.operators import experiment
from tempograph.plans.graphs import Graph
from tempograph.sources import text


@pytest.mark.parametrize("name", sorted(experiment.METHODS))
def test_every_method_gives_every_row(spark, name):
    g = Graph(relation(spark, random_edges(2, n=8, length=3)))
    found = experiment.METHODS[name](g, 2, walk_length=4, num_walks=2)
    rows = found.collect()
    assert len(rows) == 24 and all(len(r["emb"]) == 2 and np.isfinite(r["emb"]).all() for r in rows)
    stats = experiment.statistics(found).first()
    assert (stats["n_nodes"], stats["n_times"], stats["dims"], stats["n_rows"]) == (8, 3, 2, 24)


def test_cut_dimensions(spark):
    g = Graph(relation(spark, random_edges(2, n=6, length=2)))
    wide = np.zeros((2, 6, 3))
    for r in experiment.METHODS["TemporalCut"](g, 3, cut_method="laplacian").collect():
        wide[r["t"], r["i"]] = r["emb"]
    flat = wide.reshape(12, 3)
    np.testing.assert_allclose(flat.T @ flat, np.eye(3), atol=1e-9)


def test_comparison(spark):
    draw = np.random.default_rng(0)
    rows = [(m, t, i, (np.array([8.0 * (i % 2), 0.0]) * (m == "good") + draw.normal(0, 0.5, 2)).tolist()) for m in ("good", "bad") for t in range(2) for i in range(30) if not (m == "bad" and i == 29)]
    found = spark.createDataFrame(rows, "method string, t long, i long, emb array<double>")
    labels = spark.createDataFrame([(t, i, i % 2 + 5) for t in range(3) for i in range(30)], "t long, i long, label long")
    scores = {r["method"]: r for r in experiment.compare(found, labels, 2, starts=5).collect()}
    assert [scores["good"][c] for c in ("acc", "nmi", "ari", "f1")] == pytest.approx([1.0] * 4)
    assert scores["bad"]["nmi"] < 0.3 and scores["good"]["num_nodes"] == 58 and scores["good"]["num_time_steps"] == 2 and scores["good"]["num_clusters"] == 2


def test_interactions(spark):
    edges = relation(spark, [(1, 2, 1.0), (1, 2, 1.0), (3, 1, 0.0)])
    table, nodes = experiment.interactions(edges, 2, 3)
    assert [(r["u"], r["v"], r["idx"], r["label"], r["feature"]) for r in table.orderBy("idx").collect()] == [(1, 3, 0, 1.0, [0.0] * 3), (3, 1, 1, 1.0, [0.0] * 3), (1, 2, 2, 1.0, [0.0] * 3), (2, 1, 3, 1.0, [0.0] * 3)]
    assert [r["node"] for r in nodes.orderBy("node").collect()] == [0, 1, 2, 3]
    _, drawn = experiment.interactions(relation(spark, [(0, 4000, 0.0)]), 1, 1, seed=3)
    mean, deviation = drawn.select(F.avg(F.col("feature")[0]), F.stddev(F.col("feature")[0])).first()
    assert abs(mean) < 0.08 and abs(deviation - 1) < 0.08


def test_sweep_summary(spark):
    rows = [("NMI", "p0.9_q0.2", r, t, float(r)) for r in range(2) for t in range(2)] + [("NMI", "p1.0_q0.2", 0, 0, 1.0)]
    found = experiment.sweep_summary(spark.createDataFrame(rows, "metric string, pq string, run int, t int, score double")).orderBy("place").collect()
    assert [(r["pq"], r["mean"], r["std"]) for r in found] == [("p1.0_q0.2", 1.0, 0.0), ("p0.9_q0.2", 0.5, 0.5)]


def test_command_line(spark, tmp_path):
    at = f"file://{tmp_path}"
    cli.main(["generate", f"{at}/g", "--nodes", "40", "--shares", "0.5", "0.5", "--mapping", "0:0", "1:1", "--p", "0.9", "--q", "0.1", "--connected"], spark).collect()
    assert text.read_config(spark, f"{at}/g/config.txt").first()["label_mappings"] == [{0: 0}, {1: 1}]
    for name in ("UASE", "ULSE-n1"):
        stats = cli.main(["embed", f"{at}/g/run0/edges.txt", f"{at}/emb/set_{name}.emb", "--method", name, "--dims", "2"], spark).first()
        assert (stats["n_nodes"], stats["n_times"]) == (40, 2)
    for name in ("UASE", "ULSE-n1"):  # Spark writes folders; a single file of that name is what other tools expect
        part = next((tmp_path / "emb" / f"set_{name}.emb").glob("part-*"))
        (tmp_path / f"set_{name}.emb").write_bytes(part.read_bytes())
    wide = cli.main(["compare", f"{at}/*.emb", f"{at}/g/node2label.txt", f"{at}/out", "--dataset", "set", "--nodes", "40", "--clusters", "2", "--starts", "5"], spark)
    cells = {r["metric"]: r for r in wide.collect()}
    assert set(cells) == {"ACC", "NMI", "ARI", "F1"} and any("1.0000" in str(x) for x in cells["NMI"])
    stats = cli.main(["embed", f"{at}/g/run0/edges.txt", f"{at}/emb/binned", "--max-timesteps", "1", "--bias", "avg"], spark).first()
    assert stats["n_times"] == 1


def test_p_values_of_summaries(spark, tmp_path):
    at = f"file://{tmp_path}"
    schema = "metric string, pq string, mean double, std double, place int"
    text.write_summary(spark.createDataFrame([("NMI", "p0.3_q0.2", 0.4446, 0.0766, 0), ("NMI", "p1.0_q0.2", 1.0, 0.0, 1)], schema), f"{at}/a")
    text.write_summary(spark.createDataFrame([("NMI", "p0.3_q0.2", 0.3591, 0.0723, 0), ("NMI", "p1.0_q0.2", 1.0, 0.0, 1)], schema), f"{at}/b")
    cli.main(["p-values", f"{at}/a", f"{at}/b", f"{at}/p"], spark).collect()
    said = [r["value"].split("\t") for r in spark.read.text(f"{at}/p").collect()]
    assert said[0][2].startswith("p=0.0004") and said[0][3] == "(high > low)" and said[1][2] == "p=nan"


def test_label_lists_and_runs(spark, tmp_path):
    (tmp_path / "l.txt").write_text("1 5\n2 6\n1 7\n")
    assert {r["node"]: r["labels"] for r in text.read_label_lists(spark, f"file://{tmp_path}/l.txt").collect()} == {1: [5, 7], 2: [6]}
    runs = spark.createDataFrame([("NMI", 0, [1.0, 0.5], 0.75), ("NMI", 1, [0.25], 0.25)], "metric string, run int, t_scores array<double>, avg double")
    text.write_runs(runs, f"file://{tmp_path}/r")
    assert sorted(map(tuple, text.read_runs(spark, f"file://{tmp_path}/r").collect())) == sorted(map(tuple, runs.collect()))
