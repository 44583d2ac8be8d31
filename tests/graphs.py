"""Small graphs for tests, as Python values and as relations."""

import numpy as np
import pandas as pd

from tempograph.plans.graphs import Graph

#: One isolated node at each time, a self-loop, a duplicate, a reversed duplicate.
TOY = [(10, 20, 0.0), (10, 20, 0.0), (20, 10, 0.0), (20, 30, 0.0), (30, 30, 0.5), (40, 50, 0.5), (10, 50, 2.0), (20, 40, 2.0)]


def relation(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long, time double")


def toy(spark):
    return Graph(relation(spark, TOY))


def random_edges(seed, n=9, length=4, share=0.35):
    draw = np.random.default_rng(seed)
    return [(i, j, float(t)) for t in range(length) for i in range(n) for j in range(i + 1, n) if draw.random() < share or j == i + 1 and t == 0]


def snapshots(edges):
    """The dense adjacency matrices of edges."""
    nodes, times = sorted({x for e in edges for x in e[:2]}), sorted({e[2] for e in edges})
    out = np.zeros((len(times), len(nodes), len(nodes)))
    for a, b, t in edges:
        i, j, k = nodes.index(a), nodes.index(b), times.index(t)
        out[k, i, j] = out[k, j, i] = 1
    return out


def dense(df, shape, names=("t", "i", "j"), value="val"):
    out = np.zeros(shape)
    for r in df.collect():
        out[tuple(r[n] for n in names)] += r[value]
    return out


def embedding(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["t"], r["i"]] = r["emb"]
    return out


def frame(spark, schema, **columns):
    return spark.createDataFrame(pd.DataFrame(columns), schema)
