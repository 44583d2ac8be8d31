"""Unfolded spectral embeddings from one Gram matrix.

With L_t a snapshot's matrix, the left singular vectors U of [L_1 ... L_T] are the eigenvectors of
G = sum of L_t L_t', and V_t = L_t' U / sigma. So a snapshot's embedding is one sparse product:
    UASE and ULSE-n2   Y_t = L_t' U sigma^-1/2
    ULSE-n1            Y_t = -S_t U sigma^-1/2, S_t = I - L_t   (its tiled U sigma^-1/2 taken away)
Up to DENSE nodes, G comes to the driver (its size is checked: n * n numbers) and is solved there; beyond, the wanted
vectors are found component by component where none is large (by_components), and else by eigen.greatest, iterated to a tolerance, in which only matrices of n x (d + few) numbers move: between
the driver and packed cells up to LOCAL nodes, between relations beyond.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import guarded_inverse_root, inverse_root
from .components import NODES, components, fit, named
from .eigen import Arrays, Relations, dot, few_pairs, greatest, signed, snapshots_fit
from .shared import written
from .tiles import product

DENSE = 4096
#: Up to so many nodes the iterated vectors are on the driver: some 110 columns, 90 MB at 100,000.
LOCAL = 100_000


def gram(cells: DataFrame, digits: int | None = None) -> DataFrame:
    """(i, j, val) with i <= j of the sum over t of L_t L_t', from cells(t, i, j, val): the product of the unfolded matrix and its transpose; digits: as of product()."""
    n = cells.agg(F.max(F.greatest("i", "j"))).first()[0] or 0
    return product(cells.select(F.col("i").alias("x"), (F.col("t") * (n + 1) + F.col("j")).alias("k"), F.col("val").alias("v")), digits=digits)


def gram_dense(cells: DataFrame, n: int, band: int = 256) -> np.ndarray:
    """The same on the driver, for n up to DENSE: as many tasks as there are shuffle partitions add their snapshots' products,
    bands of rows are added up across tasks, and n * n numbers come to the driver."""
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def own(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((n, n))
        for _, part in rows.groupby("t"):
            x = np.zeros((n, n))
            np.add.at(x, (part["i"].to_numpy(), part["j"].to_numpy()), part["val"].to_numpy())
            total += x @ x.T
        return pd.DataFrame({"band": range(0, n, band), "g": [total[k : k + band].tobytes() for k in range(0, n, band)]})

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"band": rows["band"].iloc[:1], "g": [sum(np.frombuffer(g) for g in rows["g"]).tobytes()]})

    parts = cells.groupBy(F.expr(f"pmod(t, {tasks})")).applyInPandas(own, "band long, g binary")
    rows = parts.groupBy("band").applyInPandas(added, "band long, g binary").collect()
    return np.concatenate([np.frombuffer(r["g"]).reshape(-1, n) for r in sorted(rows, key=lambda r: r["band"])]) if rows else np.zeros((n, n))


def canonical(u: np.ndarray) -> np.ndarray:
    """Columns with signs such that their largest entry (ties: the first) is positive."""
    top = np.argmax(np.round(np.abs(u), 12), axis=0)
    return u * np.where(u[top, np.arange(u.shape[1])] < 0, -1.0, 1.0)


def pieces(cells: DataFrame, size: int = 500_000) -> DataFrame:
    """(i, c, v) of cells(t, i, j, val), a written table: a row for the cells of some columns (t, j), arrays of their row, column numbered in the row, and value."""
    cells = written(cells.select("t", "i", "j", "val"), "cells")
    number = cells.count() // size + 4 * cells.sparkSession.sparkContext.defaultParallelism

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, i, j, v = (np.concatenate(c) for c in zip(*([np.asarray(b[c]) for c in ("t", "i", "j", "val")] for b in batches), strict=True))
        order = np.lexsort((j, t))
        t, i, j, v = t[order], i[order], j[order], v[order]
        c = np.cumsum(np.r_[False, (t[1:] != t[:-1]) | (j[1:] != j[:-1])])
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (i.astype("int64"), c.astype("int64"), v.astype("float64"))], ["i", "c", "v"])

    return written(cells.groupBy(F.pmod(F.xxhash64("t", "j"), F.lit(number)).alias("piece")).applyInArrow(packed, "i binary, c binary, v binary"), "pieces")


def gram_product(found: DataFrame, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """x to G x, x of n rows on the driver: x goes to the pieces, and each task's n rows of the sum come back, one job a product."""
    found = found.coalesce(max(1, found.sparkSession.sparkContext.defaultParallelism))

    def apply(x: np.ndarray) -> np.ndarray:
        m = x.shape[1]

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((m, n))
            for batch in batches:
                for row in zip(*(batch[c] for c in ("i", "c", "v")), strict=True):
                    i, c, v = (np.frombuffer(a.as_buffer(), kind) for a, kind in zip(row, ("int64", "int64", "float64"), strict=True))
                    for k in range(m):
                        across = np.bincount(c, v * x[i, k])
                        total[k] += np.bincount(i, v * across[c], n)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["g"])

        parts = found.mapInArrow(own, "g binary").collect()
        return sum((np.frombuffer(r["g"]).reshape(m, n) for r in parts), np.zeros((m, n))).T

    return apply


def subspace(cells: DataFrame, nodes: DataFrame, d: int, rounds: int, seed: int, smallest: bool, bound: float) -> tuple[np.ndarray, DataFrame]:
    """Singular values and vectors (i, u) without G, the d first of them to the tolerance of eigen.greatest, or NotConverged after
    `rounds` rounds of G X by two sparse products. smallest: of -G, whose greatest are G's smallest. bound: G's norm, 0 if unknown.

    Up to LOCAL nodes the vectors, n x 16 (d + 4) numbers, are on the driver and the cells on the executors; beyond, both are relations.
    """
    width, sign, n = d + 4, -1.0 if smallest else 1.0, nodes.count()
    if n <= LOCAL:
        product = gram_product(pieces(cells), n)
        start = np.random.default_rng(seed).standard_normal((n, width))
        values, u = greatest(Arrays(lambda x: sign * product(x), start), width, d, n, rounds, scale=bound or None)
        made = pd.DataFrame({"i": np.arange(n), "u": canonical(u).tolist()})
        return np.sqrt(np.maximum(sign * values, 0)), cells.sparkSession.createDataFrame(made, "i long, u array<double>")
    cells = written(cells, "cells")

    def apply(x: DataFrame, m: int) -> DataFrame:
        across = cells.join(x, "i").groupBy("t", "j").agg(dot("u", m, F.col("val")).alias("u"))
        return cells.join(across, ["t", "j"]).groupBy("i").agg(dot("u", m, sign * F.col("val")).alias("u"))

    start = nodes.select("i", F.array(*[F.randn(seed + k) for k in range(width)]).alias("u"))
    values, x = greatest(Relations(apply, start, ["i"], width), width, d, n, rounds, scale=bound or None)
    return np.sqrt(np.maximum(sign * values, 0)), signed(x, ["i"], len(values))


def left_vectors(cells: DataFrame, nodes: DataFrame, n: int, d: int, smallest: bool, rounds: int = 1000, seed: int = 5, bound: float = 0.0) -> DataFrame:
    """(i, u): rows of U sigma^-1/2 for the d greatest singular values; or for d above the smallest one, descending."""
    spark = cells.sparkSession
    if n <= DENSE:
        values, vectors = np.linalg.eigh(gram_dense(cells, n))
        sigma, u = np.sqrt(np.maximum(values[::-1], 0)), canonical(vectors[:, ::-1])
        pick = slice(max(0, n - d - 1), n - 1) if smallest else slice(0, d)
        u = u[:, pick] * np.array([guarded_inverse_root(s) for s in sigma[pick]])
        return spark.createDataFrame(pd.DataFrame({"i": np.arange(n), "u": u.tolist()}), "i long, u array<double>")
    sigma, x = subspace(cells, nodes, min(d + 1 if smallest else d, n), rounds, seed, smallest, bound)
    pick = list(range(min(d, n - 1), 0, -1)) if smallest else list(range(min(d, n)))
    return x.select("i", F.array(*[F.col("u")[k] * guarded_inverse_root(float(sigma[k])) for k in pick]).alias("u"))


#: Nodes and entries over all times of a component at most, where each is solved in a task.
COMPONENT, ENTRIES = 2048, 5_000_000
#: Degrees of (t, i) at most that go to those tasks as arrays.
DEGREES = 4_000_000


@dataclass
class Scaled:
    """Cells as they are made: left(t, i)^-1/2 w right(t, j)^-1/2 of an adjacency, taken from the identity or not; left may lack t.

    make: the cells, any signs, of a part of the adjacency.
    """

    adj: DataFrame
    left: DataFrame
    right: DataFrame
    identity: bool
    make: Callable[[DataFrame], DataFrame]

    def roots(self, deg: DataFrame, n: int, length: int) -> np.ndarray:
        found = deg.select(*[c for c in ("t", "i") if c in deg.columns], inverse_root(F.col("deg")).alias("r")).toArrow()
        out = np.zeros((length, n))
        out[np.asarray(found["t"]) if "t" in deg.columns else slice(None), np.asarray(found["i"])] = np.asarray(found["r"])
        return out


def by_components(scaled: Scaled, n: int, length: int, d: int, smallest: bool) -> DataFrame | None:
    """left_vectors() of a graph of several components, the rows of zeros left out; None for one, or where one is too large for a task.

    G has no entries between components. A task makes a component's cells from its part of the adjacency, its G and the
    eigenpairs of that; the wanted ones of all are chosen by value, equal ones by component.
    """
    if n > NODES or n * length > DEGREES:
        return None
    names = components(scaled.adj, n)
    if not fit(scaled.adj, COMPONENT, ENTRIES, names):
        return None
    spark, wanted = scaled.adj.sparkSession, d + 1 if smallest else d
    left = scaled.roots(scaled.left, n, length)
    shared = spark.sparkContext.broadcast((names, left, left if scaled.left is scaled.right else scaled.roots(scaled.right, n, length)))
    identity = scaled.identity

    def pairs(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, left, right = shared.value
        own = np.flatnonzero(names == key[0].as_py())
        m = len(own)
        t, i, j, w = (np.concatenate(x) for x in zip(*([np.asarray(b[c]) for c in "tijw"] for b in batches), strict=True))
        order = np.argsort(t, kind="stable")
        t, i, j, w = t[order], i[order], j[order], w[order]
        w = w * left[t, i] * right[t, j]
        i, j = np.searchsorted(own, i), np.searchsorted(own, j)
        total, ends = np.zeros((m, m)), np.searchsorted(t, np.arange(length + 1))
        for low, high in zip(ends[:-1], ends[1:], strict=True):
            x = np.eye(m) if identity else np.zeros((m, m))
            np.add.at(x, (i[low:high], j[low:high]), -w[low:high])
            total += x @ x.T
        values, vectors = np.linalg.eigh(total)
        for k in range(m)[:wanted] if smallest else range(m)[::-1][:wanted]:
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([k]), pa.array([float(values[k])]), pa.array([vectors[:, k].tobytes()], pa.binary())], ["c", "k", "value", "u"])

    cells = named(scaled.adj, names).select("c", *[F.col(x).cast("int").alias(x) for x in "tij"], "w")
    found = written(cells.groupBy("c").applyInArrow(pairs, "c long, k long, value double, u binary"), "eigenpairs")
    every = sorted(found.select("c", "k", "value").collect(), key=lambda r: (round(r["value"], 9) * (1 if smallest else -1), r["c"], r["k"]))[:wanted]
    if smallest:
        every = every[:0:-1]
    chosen = {(r["c"], r["k"]): r["u"] for r in found.where(F.col("c").isin([r["c"] for r in every])).toLocalIterator()}
    nodes = np.flatnonzero(np.isin(names, [r["c"] for r in every]))
    u = np.zeros((len(nodes), len(every)))
    for k, r in enumerate(every):
        u[names[nodes] == r["c"], k] = canonical(np.frombuffer(chosen[r["c"], r["k"]])[:, None])[:, 0] * guarded_inverse_root(float(np.sqrt(max(r["value"], 0))))
    return spark.createDataFrame(pd.DataFrame({"i": nodes, "u": u.tolist()}), "i long, u array<double>")


def part_of(scaled: Scaled, u: DataFrame) -> DataFrame:
    """The cells of the rows that u has."""
    return scaled.make(scaled.adj.join(F.broadcast(u.select("i")), "i", "left_semi"))


def projected(cells: DataFrame, weight: Column, rows: DataFrame, u: DataFrame, d: int) -> DataFrame:
    """(t, i, emb): for every row of the spine, the sum of weight * u over the entries of its column."""
    found = cells.join(u.withColumnRenamed("i", "__i"), cells["i"] == F.col("__i")).groupBy("t", "j").agg(dot("u", d, weight).alias("emb"))
    return rows.join(found.withColumnRenamed("j", "i"), ["t", "i"], "left").select("t", "i", F.coalesce("emb", F.array(*[F.lit(0.0)] * d)).alias("emb"))


def uase(adj: DataFrame, nodes: DataFrame, rows: DataFrame, n: int, d: int) -> DataFrame:
    """Unfolded adjacency embedding, from the greatest singular values."""
    cells = adj.select("t", "i", "j", F.col("w").alias("val"))
    return projected(cells, F.col("val"), rows, left_vectors(cells, nodes, n, d, False), min(d, n))


def ulse_n2(cells: DataFrame, nodes: DataFrame, rows: DataFrame, n: int, d: int, scaled: Scaled | None = None, steps: int = 0) -> DataFrame:
    """Embedding of laplacian_n2's entries, from the greatest singular values; scaled: the same cells of `steps` times."""
    u = by_components(scaled, n, steps, d, False) if scaled and n > DENSE else None
    if u is not None:
        return projected(part_of(scaled, u), F.col("val"), rows, u, min(d, n))
    return projected(cells, F.col("val"), rows, left_vectors(cells, nodes, n, d, False), min(d, n))


def ulse_n1(cells: DataFrame, nodes: DataFrame, rows: DataFrame, n: int, d: int, steps: int, scaled: Scaled | None = None) -> DataFrame:
    """Embedding of laplacian_n1's entries, from the smallest singular values but the very smallest; scaled: the same cells."""
    u = by_components(scaled, n, steps, d, True) if scaled and n > DENSE else None
    cells, u = (cells, left_vectors(cells, nodes, n, d, True, bound=4.0 * steps)) if u is None else (part_of(scaled, u), u)
    off = F.col("val") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)
    return projected(cells, off, rows, u, min(d, max(1, n - 1)))


def omni(adj: DataFrame, rows: DataFrame, n: int, d: int) -> DataFrame:
    """(t, i, emb): the d greatest of all snapshots' singular triplets; a triplet's column is non-zero at its own time only.

    Each snapshot gives its d strongest triplets from a task of its own, which holds its entries, never its n * n cells beyond
    eigen.DENSE_SNAPSHOT nodes; the number of entries is checked. The d strongest of all are chosen by (value, t, k).
    """

    def triplets(rows_: pd.DataFrame) -> pd.DataFrame:
        values, vectors = few_pairs(rows_.rename(columns={"w": "val"}), n, d)
        u = canonical(vectors)
        return pd.DataFrame({"t": rows_["t"].iloc[0], "k": np.arange(len(values)), "sigma": np.abs(values), "u": [c.tobytes() for c in u.T]})

    found = written(snapshots_fit(adj).groupBy("t").applyInPandas(triplets, "t long, k long, sigma double, u binary"), "triplets")
    best = found.orderBy(F.desc("sigma"), "t", "k").select("t", "k", "sigma").limit(d).collect()
    place = found.sparkSession.createDataFrame([(r["t"], r["k"], c) for c, r in enumerate(best)], "t long, k long, c int")

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for t, sigma, u, c in zip(part["t"], part["sigma"], part["u"], part["c"], strict=True):
                yield pd.DataFrame({"t": t, "i": np.arange(n), "c": c, "x": np.frombuffer(u) * np.sqrt(sigma)})

    cells = found.join(F.broadcast(place), ["t", "k"]).mapInPandas(spread, "t long, i long, c int, x double")
    by_row = cells.groupBy("t", "i").agg(*[F.sum(F.when(F.col("c") == c, F.col("x"))).alias(f"c{c}") for c in range(d)])
    return rows.join(by_row, ["t", "i"], "left").select("t", "i", F.array(*[F.coalesce(f"c{c}", F.lit(0.0)) for c in range(d)]).alias("emb"))
