"""Readers and writers of the text formats.

Several formats give a row's time by its place in the file only. numbered() gives places: files are read as text,
rows get the id of their partition and their place in it, and the partitions' sizes, one number each, are added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import recoded_time
from ..operators.order import ranged, running


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of a text file, trimmed of white space at both ends, carriage returns included; empty lines are left out."""
    value = F.regexp_replace("value", r"^\s+|\s+$", "")
    return spark.read.text(path).select(value.alias("value")).where("value <> ''")


def numbered(df: DataFrame) -> DataFrame:
    """df of one file with `line`, from 0 in the file's order."""
    found = df.withColumn("__id", F.monotonically_increasing_id())
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = found.groupBy(part.alias("p")).count().collect()  # one row a partition
    before, so_far = [], 0
    for r in sorted(counts, key=lambda r: r["p"]):
        before += [F.lit(r["p"]), F.lit(so_far)]
        so_far += r["count"]
    base: Column = F.create_map(*before)[part] if before else F.lit(0)
    return found.withColumn("line", (base + place).cast("long")).drop("__id")


def tokens(df: DataFrame) -> DataFrame:
    return df.withColumn("tok", F.split("value", r"\s+"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, time) of lines of three tokens; a line with any other number of tokens, or one that is no number, is an error."""
    found = tokens(lines(spark, path))
    bad = F.raise_error(F.concat(F.lit("not an edge: "), F.col("value")))
    ok = F.size("tok") == 3
    cast = lambda k, kind: F.when(ok, F.col("tok")[k].cast(kind)).otherwise(bad.cast(kind))
    return found.select(cast(0, "long").alias("src"), cast(1, "long").alias("dst"), cast(2, "double").alias("time"))


def write_edges(edges: DataFrame, path: str) -> None:
    edges.select(F.concat_ws(" ", "src", "dst", "time").alias("value")).write.text(path)


def recode_school(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, time): lines of three tokens with recoded times; other lines are left out."""
    found = tokens(lines(spark, path)).where(F.size("tok") == 3)
    return found.select(F.col("tok")[0].cast("long").alias("src"), F.col("tok")[1].cast("long").alias("dst"), recoded_time(F.expr("try_cast(tok[2] as double)")).alias("time"))


def last_by_line(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, "line").alias(value))


def read_static_labels(spark: SparkSession, path: str) -> DataFrame:
    """(node, label): of repeated nodes the last line holds."""
    rows = numbered(tokens(lines(spark, path))).select(F.col("tok")[0].cast("long").alias("node"), F.col("tok")[1].cast("long").alias("label"), "line")
    return last_by_line(rows, ["node"], "label")


def read_labels(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(t, node, label): blocks of n lines are times; what is left at the end is not a block; in a block the last line of a node holds."""
    rows = numbered(tokens(lines(spark, path))).select((F.floor(F.col("line") / n)).alias("t"), F.col("tok")[0].cast("long").alias("node"), F.col("tok")[1].cast("long").alias("label"), "line")
    whole = rows.agg(F.floor(F.count("*") / n).alias("whole"))
    return last_by_line(rows.join(F.broadcast(whole)).where("t < whole"), ["t", "node"], "label")


def write_labels(labels: DataFrame, path: str) -> None:
    """One file, a block a time: a format without times needs its order."""
    labels.orderBy("t", "node").select(F.concat_ws(" ", "node", "label").alias("value")).coalesce(1).write.text(path)


def read_label_lists(spark: SparkSession, path: str) -> DataFrame:
    """(node, labels): all labels of a node in the file's order, whatever their time."""
    rows = numbered(tokens(lines(spark, path))).select(F.col("tok")[0].cast("long").alias("node"), F.col("tok")[1].cast("long").alias("label"), "line")
    return rows.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("line", "label"))), lambda x: x["label"]).alias("labels"))


def read_embeddings(spark: SparkSession, path: str, n: int | None = None, by_place: bool = False) -> DataFrame:
    """(t, node, emb): a header "n d", then blocks of n lines. n: the number of nodes if the header's does not hold.

    by_place: the node is the place in its block, whatever the line says. Of repeated nodes the last line holds.
    """
    rows = numbered(tokens(lines(spark, path)))
    size = n or int(rows.where("line = 0").first()["tok"][0])
    rows = rows.where("line > 0").withColumn("line", F.col("line") - 1)
    emb = F.transform(F.slice("tok", 2, F.size("tok") - 1), lambda x: x.cast("double"))
    node = F.col("line") % size if by_place else F.col("tok")[0].cast("long")
    return last_by_line(rows.select(F.floor(F.col("line") / size).alias("t"), node.alias("node"), emb.alias("emb"), "line"), ["t", "node"], "emb")


def write_embeddings(embedding: DataFrame, path: str) -> None:
    """A header and a line a (t, node), in order, in one file; numbers as short as they read back the same."""
    ends = embedding.agg(F.countDistinct("node").alias("n"), F.max(F.size("emb")).alias("d"))
    head = ends.select(F.lit(-1).cast("long").alias("t"), F.lit(-1).cast("long").alias("node"), F.concat_ws(" ", "n", "d").alias("value"))
    rows = embedding.select("t", "node", F.concat_ws(" ", F.col("node").cast("string"), F.array_join(F.transform("emb", lambda x: x.cast("string")), " ")).alias("value"))
    head.unionByName(rows).orderBy("t", "node").select("value").coalesce(1).write.text(path)


def discover_embeddings(spark: SparkSession, pattern: str, dataset: str) -> DataFrame:
    """(file, method): the .emb files that a pattern meets; the method is the file's name without the dataset's."""
    found = spark.read.format("binaryFile").load(pattern).select(F.col("path").alias("file"))
    name = F.regexp_extract("file", r"([^/]+)\.emb$", 1)
    return found.where(name != "").select("file", F.regexp_replace(name, f"^{dataset}_", "").alias("method"))


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """(metric, pq, mean, std): lines "pq mean ± std" below their "### Metric: m ###"; other lines are left out."""
    rows = numbered(lines(spark, path))
    rows = running(ranged(rows, "line"), ["line"], {"section": F.col("value").startswith("### Metric:").cast("long")})
    heads = rows.where(F.col("value").startswith("### Metric:")).select("section", F.trim(F.regexp_replace("value", r"###|Metric:", "")).alias("metric"))
    figure = rows.where(F.col("value").rlike(r"^\S+ \S+ ± \S+$")).withColumn("tok", F.split("value", " "))
    return figure.join(F.broadcast(heads), "section").select("metric", F.col("tok")[0].alias("pq"), F.expr("try_cast(tok[1] as double)").alias("mean"), F.expr("try_cast(tok[3] as double)").alias("std")).where("mean is not null and std is not null")


def write_summary(scores: DataFrame, path: str) -> None:
    """scores(metric, pq, mean, std, place) as sections in one file; place orders a section's lines."""
    row = scores.select("metric", F.col("place").cast("long").alias("place"), F.concat("pq", F.lit(" "), F.format_string("%.12f ± %.12f", "mean", "std")).alias("value"))
    head = scores.select("metric").distinct().select("metric", F.lit(-1).cast("long").alias("place"), F.concat(F.lit("### Metric: "), "metric", F.lit(" ###")).alias("value"))
    head.unionByName(row).orderBy("metric", "place").select("value").coalesce(1).write.text(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """(metric, run, t_scores, avg) of an evaluation's "Run r: Time scores: [...] | Average: x" lines."""
    rows = numbered(lines(spark, path))
    rows = running(ranged(rows, "line"), ["line"], {"section": F.col("value").startswith("### Metric:").cast("long")})
    heads = rows.where(F.col("value").startswith("### Metric:")).select("section", F.trim(F.regexp_replace("value", r"###|Metric:", "")).alias("metric"))
    form = r"^Run (\d+): Time scores: \[(.*)\] \| Average: (\S+)$"
    found = rows.where(F.col("value").rlike(form)).join(F.broadcast(heads), "section")
    part = lambda k: F.regexp_extract("value", form, k)
    return found.select("metric", part(1).cast("int").alias("run"), F.transform(F.split(part(2), r",\s*"), lambda x: x.cast("double")).alias("t_scores"), part(3).cast("double").alias("avg"))


def write_runs(scores: DataFrame, path: str) -> None:
    """scores(metric, run, t_scores, avg) as sections of runs in one file."""
    shown = F.array_join(F.transform("t_scores", lambda x: F.format_string("%.4f", x)), ", ")
    value = F.concat(F.format_string("Run %d: Time scores: [", "run"), shown, F.format_string("] | Average: %.12f", "avg"))
    rows = scores.select("metric", F.col("run").cast("long").alias("run"), value.alias("value"))
    head = scores.select("metric").distinct().select("metric", F.lit(-1).cast("long").alias("run"), F.concat(F.lit("### Metric: "), "metric", F.lit(" ###")).alias("value"))
    head.unionByName(rows).orderBy("metric", "run").select("value").coalesce(1).write.text(path)


def write_p_values(found: DataFrame, path: str, high: str, low: str) -> None:
    """found(metric, pq, p, direction) as tab-separated lines."""
    p = F.coalesce(F.format_string("%.12f", "p"), F.lit("nan"))
    value = F.concat_ws("\t", "metric", "pq", F.concat(F.lit("p="), F.when(F.col("p").isNull(), F.lit("nan")).otherwise(p)), F.concat(F.lit(f"({high} "), "direction", F.lit(f" {low})")))
    found.orderBy("metric", "pq").select(value.alias("value")).coalesce(1).write.text(path)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """One row (k, pi, seed, p, q, label_mappings) of a model's description."""
    rows = lines(spark, path).withColumn("key", F.element_at(F.split("value", r"\s+"), 1)).withColumn("rest", F.trim(F.expr("substring(value, length(key) + 1)")))
    value = lambda key: F.max(F.when(F.col("key") == key, F.col("rest")))
    pairs = F.transform(F.split(F.regexp_extract("rest", r"^\d+:\s*(.*)$", 1), r",\s*"), lambda x: F.split(x, "->"))
    mapping = F.map_from_entries(F.transform(pairs, lambda x: F.struct(x[0].cast("int").alias("k"), x[1].cast("int").alias("v"))))
    times = F.sort_array(F.collect_list(F.when(F.col("key") == "time", F.struct(F.regexp_extract("rest", r"^(\d+):", 1).cast("int").alias("t"), F.map_entries(mapping).alias("m")))))
    found = rows.agg(value("K").cast("int").alias("k"), F.transform(F.split(value("pi"), " "), lambda x: x.cast("double")).alias("pi"), value("seed").cast("int").alias("seed"), value("p").cast("double").alias("p"), value("q").cast("double").alias("q"), times.alias("times"))
    return found.select("k", "pi", "seed", "p", "q", F.transform("times", lambda x: F.map_from_entries(x["m"])).alias("label_mappings"))


def write_config(spark: SparkSession, path: str, k: int, pi: list[float], seed: int, mappings: list[dict[int, int]], p: float | None = None, q: float | None = None) -> None:
    text = [f"K {k}", "pi " + " ".join(map(str, pi)), f"seed {seed}"]
    text += [f"p {p}", f"q {q}"] if p is not None and q is not None else []
    text += ["label_mappings", *(f"time {t}: " + ", ".join(f"{a}->{b}" for a, b in m.items()) for t, m in enumerate(mappings, 1))]
    spark.createDataFrame([(x,) for x in text], "value string").coalesce(1).write.text(path)


def carry_section(rows: DataFrame) -> DataFrame:
    """Rows (file, line, value) with the last header of the same file, for many small files: a window in each file."""
    window = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(F.when(F.col("value").startswith("###"), F.col("value")), ignorenulls=True).over(window))


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.coalesce(1).write.option("header", True).option("sep", sep).csv(path)
