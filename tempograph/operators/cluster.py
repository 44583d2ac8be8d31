"""k-means of each snapshot's embedding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plus_plus(x: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray:
    centres = [x[draw.integers(len(x))]]
    near = ((x - centres[0]) ** 2).sum(1)
    for _ in range(1, k):
        total = near.sum()
        centres.append(x[draw.choice(len(x), p=near / total) if total > 0 else draw.integers(len(x))])
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(1))
    return np.array(centres)


def lloyd(x: np.ndarray, k: int, starts: int, seed: int, rounds: int = 300) -> tuple[np.ndarray, float]:
    """The best of some seeded runs: labels and the sum of squared distances."""
    best, cost = np.zeros(len(x), "int64"), np.inf
    draw = np.random.default_rng(seed)
    for _ in range(starts):
        centres, before = plus_plus(x, k, draw), None
        for _ in range(rounds):
            apart = ((x[:, None, :] - centres) ** 2).sum(2) if x.size * k < 5e7 else (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)
            label = apart.argmin(1)
            if before is not None and (label == before).all():
                break
            before = label
            for c in range(k):
                if (own := label == c).any():
                    centres[c] = x[own].mean(0)
        now = float(apart[np.arange(len(x)), label].sum())
        if now < cost - 1e-12:
            best, cost = label, now
    return best, cost


def per_time(embedding: DataFrame, k: int | dict[int, int], starts: int = 10, seed: int = 42) -> DataFrame:
    """(t, i, cluster): every snapshot by itself, at most as many clusters as rows. k: one number, or one for each t."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        t = int(rows["t"].iloc[0])
        x = np.stack(rows["emb"].to_numpy())
        want = k.get(t, max(k.values())) if isinstance(k, dict) else k
        label, _ = lloyd(x, min(want, len(x)), starts, seed)
        return pd.DataFrame({"t": rows["t"], "i": rows["i"], "cluster": label})

    return embedding.select("t", "i", "emb").groupBy("t").applyInPandas(one, "t long, i long, cluster long")


def pooled(vectors: DataFrame, k: int, seed: int = 42, rounds: int = 20) -> DataFrame:
    """vectors(id, emb) with one clustering over all rows, by the distributed k-means of the library."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    found = vectors.withColumn("__v", array_to_vector(F.col("emb").cast("array<double>")))
    model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="__v", predictionCol="cluster").fit(found)
    return model.transform(found).drop("__v").withColumn("cluster", F.col("cluster").cast("long"))
