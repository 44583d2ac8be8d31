"""Transition probabilities, biased random walks and skip-gram vectors of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written


def first_order(edges: DataFrame) -> DataFrame:
    """(t, i, j, p) of edges(t, i, j, w): w over the sum of the node's weights at t."""
    return edges.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("t", "i"))).select("t", "i", "j", "p")


def second_order(edges: DataFrame, p: float, q: float) -> DataFrame:
    """(t, i, j, k, prob): after a step from i to j, the chance of going on to k.

    The weight of (j, k) is divided by p if k is i, kept if k has an edge to i, and divided by q otherwise.
    """
    step = edges.select("t", "i", "j")
    on = edges.select("t", F.col("i").alias("j"), F.col("j").alias("k"), "w")
    back = edges.select("t", F.col("i").alias("k"), F.col("j").alias("i"), F.lit(True).alias("near"))
    paths = step.join(on, ["t", "j"]).join(back, ["t", "k", "i"], "left")
    weight = F.when(F.col("k") == F.col("i"), F.col("w") / p).when(F.col("near"), F.col("w")).otherwise(F.col("w") / q)
    paths = paths.withColumn("v", weight)
    return paths.select("t", "i", "j", "k", (F.col("v") / F.sum("v").over(Window.partitionBy("t", "i", "j"))).alias("prob"))


def walks(edges: DataFrame, rows: DataFrame, n_walks: int, length: int, p: float, q: float, seed: int = 1) -> DataFrame:
    """(t, walk, path): n_walks walks of up to `length` nodes from every node of the spine, each snapshot by itself.

    All walks take a step together: a join with the neighbours of where they are. A neighbour's chance comes from a
    hash of (seed, walk, step, neighbour) in an exponential race, so that a repeated task walks the same way. A walk
    at a node without edges ends.
    """
    around = edges.groupBy("t", "i").agg(F.sort_array(F.collect_list(F.struct("j", "w"))).alias("next"))
    near = written(around.withColumn("ids", F.transform("next", lambda x: x["j"])), "neighbours")
    start = rows.select("t", "i", F.explode(F.sequence(F.lit(0), F.lit(n_walks - 1))).alias("turn"))
    now = start.select("t", F.struct("i", "turn").alias("walk"), F.array("i").alias("path"), F.col("i").alias("at"), F.lit(None).cast("array<long>").alias("before"))
    ended = None

    def choose(parts: Iterator[pd.DataFrame], step: int) -> Iterator[pd.DataFrame]:
        for part in parts:
            to = []
            for t, walk, path, before, options in zip(part["t"], part["walk"], part["path"], part["before"], part["next"], strict=True):
                ids, w = np.array([o["j"] for o in options]), np.array([o["w"] for o in options], float)
                if len(path) > 1:
                    w = np.where(ids == path[-2], w / p, np.where(np.isin(ids, before), w, w / q))
                draw = np.random.default_rng([seed, int(t), int(walk["i"]), int(walk["turn"]), step])
                to.append(int(ids[np.searchsorted(np.cumsum(w), draw.random() * w.sum(), side="right").clip(max=len(ids) - 1)]))
            yield pd.DataFrame({"t": part["t"], "i": [x["i"] for x in part["walk"]], "turn": [x["turn"] for x in part["walk"]], "path": part["path"], "to": to, "ids": part["ids"]})

    for step in range(1, length):
        here = now.join(near.withColumnRenamed("i", "at"), ["t", "at"], "left")
        stop = here.where("next is null").select("t", "walk", "path")
        ended = stop if ended is None else ended.unionByName(stop)
        went = here.where("next is not null").select("t", "walk", "path", "before", "next", "ids")
        went = went.mapInPandas(lambda parts, step=step: choose(parts, step), "t long, i long, turn int, path array<long>, to long, ids array<long>")
        now = went.select("t", F.struct("i", "turn").alias("walk"), F.concat("path", F.array("to")).alias("path"), F.col("to").alias("at"), F.col("ids").alias("before"))
        if step % 8 == 0:
            now, ended = written(now, "walks"), written(ended, "ended")
    done = now.select("t", "walk", "path")
    return done if ended is None else done.unionByName(ended)


def skip_gram(paths: DataFrame, rows: DataFrame, d: int, window: int = 5, seed: int = 1, iterations: int = 1) -> DataFrame:
    """(t, i, emb): skip-gram vectors of the walks, words being nodes at a time, so that snapshots share no vector; nodes without walks are zeros."""
    from pyspark.ml.feature import Word2Vec

    said = paths.select(F.transform("path", lambda x: F.concat_ws("@", x.cast("string"), F.col("t").cast("string"))).alias("words"))
    model = Word2Vec(vectorSize=d, minCount=0, windowSize=window, seed=seed, maxIter=iterations, inputCol="words", outputCol="v").fit(said)
    from pyspark.ml.functions import vector_to_array

    part = F.split("word", "@")
    found = model.getVectors().select(part[1].cast("long").alias("t"), part[0].cast("long").alias("i"), vector_to_array("vector").alias("emb"))
    return rows.join(found, ["t", "i"], "left").select("t", "i", F.coalesce("emb", F.array(*[F.lit(0.0)] * d)).alias("emb"))
