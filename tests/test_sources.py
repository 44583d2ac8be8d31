import pytest
from pyspark.sql import functions as F

from graphs import relation
from tempograph.sources import text
from tempograph.streaming import snapshots


def put(tmp_path, name, content):
    path = tmp_path / name
    path.write_bytes(content.encode())
    return f"file://{path}"


def test_edges(spark, tmp_path):
    path = put(tmp_path, "e.txt", "1 2 0.5\r\n\n  3\t4   1\n")
    assert sorted(map(tuple, text.read_edges(spark, path).collect())) == [(1, 2, 0.5), (3, 4, 1.0)]
    with pytest.raises(Exception, match="not an edge"):
        text.read_edges(spark, put(tmp_path, "bad.txt", "1 2\n")).collect()


def test_edge_round_trip(spark, tmp_path):
    edges = relation(spark, [(1, 2, 0.5), (1, 2, 0.5), (3, 4, 1e-7)])
    text.write_edges(edges, f"file://{tmp_path}/out")
    assert sorted(map(tuple, text.read_edges(spark, f"file://{tmp_path}/out").collect())) == sorted(map(tuple, edges.collect()))


def test_school_times(spark, tmp_path):
    path = put(tmp_path, "s.txt", "1 2 0\n1 2 0.2\n1 2 0.79\n1 2 0.8\n1 2 -3\n1 2 x\n1 2\n")
    assert sorted(r["time"] for r in text.recode_school(spark, path).collect()) == [0, 0, 1, 2, 4, 5]


def test_labels(spark, tmp_path):
    path = put(tmp_path, "l.txt", "2 5\r\n1 4\r\n2 6\r\n1 7\r\n9 9")
    assert sorted(map(tuple, text.read_labels(spark, path, 2).collect())) == [(0, 1, 4), (0, 2, 5), (1, 1, 7), (1, 2, 6)]
    assert sorted(map(tuple, text.read_static_labels(spark, path).collect())) == [(1, 7), (2, 6), (9, 9)]


def test_many_lines_keep_their_places(spark, tmp_path):
    path = put(tmp_path, "long.txt", "".join(f"{k % 100} {k}\n" for k in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = text.read_labels(spark, path, 100)
        assert found.where(F.col("label") != F.col("t") * 100 + F.col("node")).isEmpty() and found.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_embeddings(spark, tmp_path):
    emb = spark.createDataFrame([(t, n, [t + 0.1, n * 1e-9]) for t in range(3) for n in (4, 2)], "t long, node long, emb array<double>")
    text.write_embeddings(emb, f"file://{tmp_path}/x.emb")
    back = text.read_embeddings(spark, f"file://{tmp_path}/x.emb")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, emb.collect()))
    places = text.read_embeddings(spark, f"file://{tmp_path}/x.emb", by_place=True)
    assert sorted({r["node"] for r in places.collect()}) == [0, 1]
    assert text.read_embeddings(spark, f"file://{tmp_path}/x.emb", n=3).agg(F.max("t")).first()[0] == 1


def test_discovery(spark, tmp_path):
    for name in ("school_USE_UASE.emb", "school_OMNI.emb", "other.txt"):
        put(tmp_path, name, "1 1\n")
    found = text.discover_embeddings(spark, f"file://{tmp_path}/*.emb", "school")
    assert sorted(r["method"] for r in found.collect()) == ["OMNI", "USE_UASE"]


def test_summary_round_trip(spark, tmp_path):
    rows = [("NMI", "p1.0_q0.2", 1.0, 0.0, 0), ("NMI", "p0.9_q0.2", 0.5, 0.25, 1), ("ARI", "p1.0_q0.2", -0.25, 0.125, 0)]
    text.write_summary(spark.createDataFrame(rows, "metric string, pq string, mean double, std double, place int"), f"file://{tmp_path}/s.txt")
    assert sorted(map(tuple, text.read_summary(spark, f"file://{tmp_path}/s.txt").collect())) == sorted(r[:4] for r in rows)
    odd = put(tmp_path, "odd.txt", "## Summary ##\n\n### Metric: NMI ###\np1 0.5 ± 0.1\nbroken line\np2 x ± 0.1\n")
    assert [tuple(r) for r in text.read_summary(spark, odd).collect()] == [("NMI", "p1", 0.5, 0.1)]


def test_runs(spark, tmp_path):
    path = put(tmp_path, "r.txt", "### Metric: NMI ###\nRun 0: Time scores: [1.0000, 0.5000] | Average: 0.750000000000\n### Metric: ARI ###\nRun 1: Time scores: [0.1] | Average: 0.1\n")
    assert [tuple(r) for r in text.read_runs(spark, path).orderBy("run").collect()] == [("NMI", 0, [1.0, 0.5], 0.75), ("ARI", 1, [0.1], 0.1)]


def test_config_round_trip(spark, tmp_path):
    maps = [{0: 0, 1: 1}, {0: 0, 1: 0}]
    text.write_config(spark, f"file://{tmp_path}/c.txt", 2, [0.5, 0.5], 42, maps, 0.5, 0.2)
    found = text.read_config(spark, f"file://{tmp_path}/c.txt").first()
    assert (found["k"], found["pi"], found["seed"], found["p"], found["q"], found["label_mappings"]) == (2, [0.5, 0.5], 42, 0.5, 0.2, maps)
    text.write_config(spark, f"file://{tmp_path}/d.txt", 2, [1.0], 1, maps)
    assert text.read_config(spark, f"file://{tmp_path}/d.txt").first()["p"] is None


def test_csv(spark, tmp_path):
    text.write_csv(spark.createDataFrame([("a", 1.5)], "m string, v double"), f"file://{tmp_path}/t.csv", "\t")
    assert [tuple(r) for r in spark.read.option("header", True).option("sep", "\t").csv(f"file://{tmp_path}/t.csv").collect()] == [("a", "1.5")]


def test_stream_matches_batch(spark, tmp_path):
    rows = [(f"2024-01-0{d} 0{h}:00:00", u, v) for d in (1, 2) for h in (1, 5) for u in (1, 2) for v in (3, 3)]
    events = spark.createDataFrame(rows, "ts string, src long, dst long").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"file://{tmp_path}/events")
    found = snapshots.run_snapshot_counts(snapshots.stream_events(spark, f"file://{tmp_path}/events"))
    assert sorted((r["src"], r["events"]) for r in found.collect()) == [(1, 4), (1, 4), (2, 4), (2, 4)]
    assert snapshots.snapshot_edges(events).count() == 4
