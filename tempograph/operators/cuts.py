"""Temporal cuts: the supra-Laplacian, vectors that separate, and sweeps over a score.

A sweep adds (t, i) pairs to a set in the order of a score. What each pair changes, in cut edges, swaps between
times and the balance, depends only on its rank and on those of its neighbours, so all prefixes are scored by
joins and running sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import inverse_root
from . import matrices
from .components import NODES, components, contrasts, fit, named
from .eigen import HELD, Arrays, Relations, dot, extreme, few_pairs, greatest, signed, smallest_pairs, snapshots_fit, sparse_product
from .order import ranged, running
from .shared import written
from .spectral import canonical


def swaps(rows: DataFrame, times: DataFrame, n: int, cost: float) -> DataFrame:
    """(row, col, val): what links between a node's neighbouring times add to the supra-Laplacian; row is t * n + i."""
    here = rows.join(F.broadcast(times.agg(F.max("t").alias("last")))).where("t < last")
    a, b = F.col("t") * n + F.col("i"), (F.col("t") + 1) * n + F.col("i")
    four = F.array(*[F.struct(x.alias("row"), y.alias("col"), F.lit(v).alias("val")) for x, y, v in ((a, b, -cost), (b, a, -cost), (a, a, cost), (b, b, cost))])
    return here.select(F.explode(four).alias("e")).select("e.row", "e.col", "e.val")


def supra_laplacian(adj: DataFrame, rows: DataFrame, times: DataFrame, n: int, cost: float = 1.0, normalized: bool = False) -> DataFrame:
    """(row, col, val): snapshots' Laplacians on the diagonal and swap links beside it.

    normalized: the snapshots' n1 Laplacians, and then the whole scaled by the roots of its row sums, where those
    are positive to nine digits (0 elsewhere).
    """
    deg = matrices.degree(adj, rows)
    blocks = matrices.laplacian_n1(adj, deg) if normalized else matrices.laplacian(adj, deg)
    cells = blocks.select((F.col("t") * n + F.col("i")).alias("row"), (F.col("t") * n + F.col("j")).alias("col"), "val")
    cells = cells.unionByName(swaps(rows, times, n, cost)).groupBy("row", "col").agg(F.sum("val").alias("val"))
    if not normalized:
        return cells
    root = cells.groupBy("row").agg(inverse_root(F.round(F.sum("val"), 9)).alias("r"))
    left, right = root.select("row", F.col("r").alias("a")), root.select(F.col("row").alias("col"), F.col("r").alias("b"))
    return cells.join(left, "row").join(right, "col").select("row", "col", (F.col("val") * F.col("a") * F.col("b")).alias("val"))


def complete_apply(x: DataFrame, n: int, column: str = "x") -> DataFrame:
    """(t, i, x) to C x, C the complete graph's Laplacian at each t: n x - sum(x), without its n * n entries."""
    total = x.groupBy("t").agg(F.sum(column).alias("__sum"))
    return x.join(total, "t").select("t", "i", (n * F.col(column) - F.col("__sum")).alias(column))


def steps(scores: DataFrame, every: int = 1) -> DataFrame:
    """(t, i, r): ranks from 1 by score, ties by t, then i; of each `every` ranks the first stays, numbered anew."""
    found = running(ranged(scores, "ev"), ["ev", "t", "i"], {"r": F.lit(1)}).select("t", "i", "r")
    return found.where((F.col("r") - 1) % every == 0).withColumn("r", F.floor((F.col("r") - 1) / every) + 1) if every > 1 else found


#: Up to so many pairs (t, i) their ranks go to the adjacency as one array; beyond, its rows are shuffled to them.
RANKS = 4_000_000


def edge_changes(order: DataFrame, adj: DataFrame, n: int, length: int) -> DataFrame:
    """(t, i, edges): what each ranked pair adds to the cut: its edges but for those to smaller ranks, less those."""
    if n * length > RANKS:
        other = order.select(F.col("t"), F.col("i").alias("j"), F.col("r").alias("s"))
        edges = adj.where("i <> j").join(order, ["t", "i"]).join(other, ["t", "j"], "left")
        return edges.groupBy("t", "i").agg(F.sum(F.col("w") * F.when(F.col("s") < F.col("r"), -1).otherwise(1)).alias("edges"))
    ranked, none = order.select("t", "i", "r").toArrow(), np.iinfo("int64").max
    ranks = np.full(n * length, none)
    ranks[np.asarray(ranked["t"]) * n + np.asarray(ranked["i"])] = np.asarray(ranked["r"])
    context = adj.sparkSession.sparkContext
    shared = context.broadcast(ranks)

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        total = np.zeros(len(ranks))
        for batch in batches:
            t, i, j, w = (np.asarray(batch[c]) for c in "tijw")
            own = t * n + i
            a, b = ranks[own], ranks[t * n + j]
            np.add.at(total, own, np.where(a == none, 0.0, np.where(b < a, -w, w)))
        t, i = np.divmod(np.flatnonzero(total), n)
        for at in range(0, len(t), 1 << 16):
            cut = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(t[cut]), pa.array(i[cut]), pa.array(total[t[cut] * n + i[cut]])], ["t", "i", "edges"])

    rows = adj.where("i <> j").select("t", "i", "j", "w").coalesce(max(1, context.defaultParallelism))
    return rows.mapInArrow(changes, "t long, i long, edges double").groupBy("t", "i").agg(F.sum("edges").alias("edges"))


def sweep(scores: DataFrame, adj: DataFrame, n: int, last: int, cost: float = 1.0, normalized: bool = False, every: int = 1) -> DataFrame:
    """(t, i, r, edges, swaps, balance): for each prefix of the order, the cut edges, the swaps, and the denominator.

    scores(t, i, ev). The denominator is the sum over t of s(n - s), s the prefix's size at t; normalized: of
    volume * (total - volume). Self-loops are never cut. every: only each such pair enters (see steps).
    """
    order = written(steps(scores, every), "order")
    edges = edge_changes(order, adj, n, last + 1)
    beside = Window.partitionBy("i").orderBy("t")
    sign = lambda at, step: F.when((F.lag("t", step).over(beside) == at) & (F.lag("r", step).over(beside) < F.col("r")), -cost).otherwise(cost)
    links = F.when(F.col("t") > 0, sign(F.col("t") - 1, 1)).otherwise(0.0) + F.when(F.col("t") < last, sign(F.col("t") + 1, -1)).otherwise(0.0)
    own = Window.partitionBy("t").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    if normalized:
        deg = adj.groupBy("t", "i").agg(F.sum("w").alias("d"))
        total = deg.groupBy("t").agg(F.sum("d").alias("v"))
        placed = order.join(deg, ["t", "i"], "left").join(total, "t", "left").fillna(0.0, ["d", "v"])
        balance = F.col("d") * (F.col("v") - 2 * (F.sum("d").over(own) - F.col("d")) - F.col("d"))
    else:
        placed = order
        balance = n - 2 * (F.count("*").over(own) - 1) - 1
    placed = placed.withColumn("swaps", links).withColumn("balance", balance.cast("double")).join(edges, ["t", "i"], "left")
    found = ranged(placed.select("t", "i", "r", F.coalesce("edges", F.lit(0.0)).alias("edges"), "swaps", "balance"), "r")
    return running(found, ["r"], {c: F.col(c) for c in ("edges", "swaps", "balance")}).select("t", "i", "r", "edges", "swaps", "balance")


def best_cut(swept: DataFrame) -> DataFrame:
    """(r, score, edges, swaps) of the prefix with the smallest score, the first of such; no row if no prefix has a positive denominator."""
    score = (F.col("edges") + F.col("swaps")) / F.col("balance")
    return swept.where("balance > 0").withColumn("score", score).orderBy("score", "r").limit(1).select("r", "score", "edges", "swaps")


def sides(swept: DataFrame, rows: DataFrame) -> DataFrame:
    """(t, i, side): -1 inside the best prefix, 1 outside; all 1 without one."""
    inside = swept.join(F.broadcast(best_cut(swept).select(F.col("r").alias("until")))).where("r <= until").select("t", "i", F.lit(-1).cast("long").alias("side"))
    return rows.join(inside, ["t", "i"], "left").select("t", "i", F.coalesce("side", F.lit(1)).cast("long").alias("side"))


def fast_vector(adj: DataFrame, rows: DataFrame, n: int, length: int, beta: float = 1.0, rank: int = 32, normalized: bool = False) -> DataFrame:
    """(t, i, ev): each snapshot's smallest eigenpairs, joined over time by one small problem for each pair's number.

    Link terms join equal numbers only, so that the whole problem falls into one tridiagonal problem of T x T for
    each number k >= 1; the one with the greatest eigenvalue gives the weights. Pair 0 is the constant vector. As a snapshot's
    values ascend, problem 1 less any further one is a diagonal matrix without negative numbers: no further one has a greater
    eigenvalue, and at equal ones the first counts, so that of `rank` pairs 0 and 1 alone are needed. A snapshot's
    entries, not its n * n cells, are in one task, which solves its components one by one; their number is checked.
    """
    r, c = min(rank, n - 1, 2), 3.0 * (n + 2.0 * beta) * n

    def pairs(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j, w = (np.concatenate(x) for x in zip(*([np.asarray(b[c]) for c in "ijw"] for b in batches), strict=True))
        values, vectors = smallest_pairs(i, j, w, n, r, normalized, few_pairs)
        for k, u in enumerate(canonical(vectors).T):
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([k]), pa.array([float(values[k])]), pa.array([u.tobytes()], pa.binary())], ["t", "k", "lam", "u"])

    cells = snapshots_fit(adj).select("t", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "w")
    found = written(cells.groupBy("t").applyInArrow(pairs, "t long, k long, lam double, u binary"), "eigenpairs")

    def small(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t")
        m = np.diag(c - part["lam"].to_numpy() if part["k"].iloc[0] else np.zeros(len(part)))
        links = np.zeros(len(part))
        links[1:] += beta
        links[:-1] += beta
        m = m - np.diag(links) - beta * (np.eye(len(part), k=1) + np.eye(len(part), k=-1))
        values, vectors = np.linalg.eigh(m)
        return pd.DataFrame({"t": part["t"], "k": part["k"], "value": values[-1], "weight": canonical(vectors[:, -1:])[:, 0]})

    weights = written(found.select("t", "k", "lam").groupBy("k").applyInPandas(small, "t long, k long, value double, weight double"), "weights")
    top = weights.groupBy("k").agg(F.max("value").alias("value")).orderBy(F.desc(F.round("value", 9)), "k").first()["k"]
    chosen = found.where(F.col("k") == top).join(F.broadcast(weights.where(F.col("k") == top).select("t", "weight")), "t")  # one row a time

    def spread(parts):
        for part in parts:
            for t, u, w in zip(part["t"], part["u"], part["weight"], strict=True):
                yield pd.DataFrame({"t": t, "i": np.arange(n), "ev": np.frombuffer(u) * w})

    return chosen.select("t", "u", "weight").mapInPandas(spread, "t long, i long, ev double")


def by_components(method: str, adj: DataFrame, rows: DataFrame, n: int, length: int, cost: float, dims: int, local: int) -> DataFrame | None:
    """vector() of a graph of several components over all times, not normalized; None for one, or where one is too large for a task.

    L has no entries between components, and takes f(t) a(component) to its path of times alone. The complement of f(t) is where
    C is n, and L's own: diff's greatest pairs are L's smallest there, prod's are L's greatest. A vector that differs between
    components and not in time is of L's smallest value, 0; so it is laplacian's second and diff's first. For prod each component's
    greatest pairs are iterated in a task, and meet those of vectors that differ between components and alternate in time.
    """
    spark = adj.sparkSession
    names = components(adj, n)
    number = len(np.unique(names))
    if number < 2 or method != "prod" and number <= dims:
        return None
    flat = contrasts(np.ones(n), names, dims + 1)[:, 1:]
    line = np.linalg.eigh(np.diag(line_degrees(length)) - np.eye(length, k=1) - np.eye(length, k=-1))
    if method != "prod":
        found = [(flat[:, k], np.full(length, length**-0.5)) for k in range(dims)]
        return spread_out(spark, rows, found, dims)
    if not fit(adj, local // 40 // length, local, names):
        return None
    shared = spark.sparkContext.broadcast(names)

    def pairs(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.flatnonzero(shared.value == key[0].as_py())
        m = len(own)
        t, i, j, w = (np.concatenate(x) for x in zip(*([np.asarray(b[c]) for c in "tijw"] for b in batches), strict=True))
        if m < 2:
            return
        i, j = (t.astype("int64") * m + np.searchsorted(own, x) for x in (i, j))
        diagonal = np.bincount(i, w, m * length)
        minus = sparse_product(pd.DataFrame({"row": i, "col": j, "val": -w}), m * length)
        bound = 2 * float(diagonal.max()) + 4 * cost
        diagonal = diagonal.reshape(length, m, 1)

        def beside(y: np.ndarray) -> np.ndarray:
            return y - y.mean(1, keepdims=True)

        def apply(x: np.ndarray) -> np.ndarray:
            y = beside(x.reshape(length, m, -1))
            out = diagonal * y + minus(y.reshape(x.shape)).reshape(y.shape)
            step = cost * (y[1:] - y[:-1])
            out[1:] += step
            out[:-1] -= step
            return beside(out).reshape(x.shape)

        space = (m - 1) * length
        width = min(max(8, dims + 4), space)
        start = beside(np.random.default_rng(3).standard_normal((length, m, width))).reshape(-1, width)
        values, vectors = greatest(Arrays(apply, start), width, min(dims, space), space, 2000, scale=bound)
        for k in range(min(dims, len(values))):
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([k]), pa.array([float(values[k])]), pa.array([vectors[:, k].tobytes()], pa.binary())], ["c", "k", "value", "u"])

    cells = named(adj, names).select("c", *[F.col(x).cast("int").alias(x) for x in "tij"], "w")
    found = written(cells.groupBy("c").applyInArrow(pairs, "c long, k long, value double, u binary"), "eigenpairs")
    between = [(cost * float(line[0][f]), -1, f, k) for f in range(length) for k in range(flat.shape[1])]
    every = sorted([(r["value"], r["c"], r["k"], 0) for r in found.select("c", "k", "value").collect()] + between, key=lambda p: (-round(p[0], 9), p[1:]))[:dims]
    made = []
    for _, c, a, k in every:
        if c < 0:
            made.append((flat[:, k], line[1][:, a]))
            continue
        own = np.flatnonzero(names == c)
        u = np.frombuffer(found.where((F.col("c") == c) & (F.col("k") == a)).first()["u"]).reshape(length, -1)
        made.append((own, u))
    return spread_out(spark, rows, made, dims)


#: Entries of a part of a snapshot, which a task takes at once.
PART = 500_000


def parts_of(adj: DataFrame, n: int, length: int) -> DataFrame:
    """(t, i, at, j, w), a written table: rows of a snapshot without its diagonal, packed: their numbers, where their entries begin, columns, and weights, one if all are equal."""
    cells = adj.where("i <> j")
    step = -(-n // max(1, -(-cells.count() // (length * PART))))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, i, j, w = (np.concatenate(c) for c in zip(*([np.asarray(b[c]) for c in "tijw"] for b in batches), strict=True))
        order = np.lexsort((j, i))
        i, j, w = i[order], j[order], w[order]
        at = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        w = w[:1] if (w == w[0]).all() else w
        yield pa.RecordBatch.from_arrays([pa.array(t[:1]), *(pa.array([c.tobytes()], pa.binary()) for c in (i[at], at.astype("int32"), j, w))], ["t", "i", "at", "j", "w"])

    found = cells.select("t", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("w").cast("double").alias("w"), (F.col("t") * n + F.floor(F.col("i") / step)).alias("part"))
    number = 4 * adj.sparkSession.sparkContext.defaultParallelism
    return written(found.repartition(number, "part").groupBy("part").applyInArrow(packed, "t long, i binary, at binary, j binary, w binary"), "parts")


def snapshots_product(found: DataFrame, n: int, length: int):
    """x to A x, the snapshots' entries of parts_of() side by side: rows of t * n + i, one job a product; x goes to all tasks, and a row's sums come back once."""
    context = found.sparkSession.sparkContext

    def apply(x: np.ndarray) -> np.ndarray:
        m = len(x)
        shared = context.broadcast(x.reshape(m, length, n))

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = shared.value
            for batch in batches:
                for t, *arrays in zip(*(batch[c] for c in ("t", "i", "at", "j", "w")), strict=True):
                    i, at, j, w = (np.frombuffer(a.as_buffer(), kind) for a, kind in zip(arrays, ("int32", "int32", "int32", "float64"), strict=True))
                    j, at = j.astype(np.intp), at.astype(np.intp)
                    sums = [np.add.reduceat(row.take(j) * w if len(w) > 1 else row.take(j), at) * (w[0] if len(w) == 1 else 1.0) for row in x[:, t.as_py()]]
                    yield pa.RecordBatch.from_arrays([pa.array([t.as_py()]), pa.array([i.tobytes()], pa.binary()), pa.array([np.stack(sums).tobytes()], pa.binary())], ["t", "i", "y"])

        out = np.zeros((m, length, n))
        for r in found.mapInArrow(own, "t long, i binary, y binary").collect():
            i = np.frombuffer(r["i"], "int32")
            out[:, r["t"], i] = np.frombuffer(r["y"]).reshape(m, -1)
        shared.destroy()
        return out.reshape(m, -1)

    return apply


def beside_flat(method: str, adj: DataFrame, rows: DataFrame, n: int, length: int, coefficient: float, cost: float, dims: int) -> DataFrame:
    """vector() without normalisation, to a tolerance; vectors of n * length numbers are on the driver, the entries on the executors.

    L takes vectors that are equal on a snapshot's nodes (flat) to such ones, as the path of times does, whose eigenpairs are known,
    and its other vectors, whose sums are 0 at each t, to such ones; there C is n, so that diff's greatest pairs are L's smallest
    and prod's are L's greatest. On flat ones C is 0.
    """
    size, sign = n * length, 1.0 if method == "prod" else -1.0
    line, f = np.linalg.eigh(np.diag(line_degrees(length)) - np.eye(length, k=1) - np.eye(length, k=-1))
    flat = [({"diff": -cost * x, "laplacian": -cost * x, "prod": 0.0}[method], k) for k, x in enumerate(line)][1 if method == "laplacian" else 0 :]
    space = (n - 1) * length
    values, vectors = np.zeros(0), np.zeros((0, size))
    if space:
        adjacent = snapshots_product(parts_of(adj, n, length), n, length)
        degrees = adjacent(np.ones((1, size)))[0].reshape(length, n)
        diagonal = sign * (degrees + cost * line_degrees(length)[:, None])
        scale = 2 * float(np.abs(diagonal).max())

        def inside(x: np.ndarray) -> np.ndarray:
            y = x.reshape(len(x), length, n)
            return (y - y.mean(2, keepdims=True)).reshape(x.shape)

        def apply(x: np.ndarray) -> np.ndarray:
            out = diagonal.reshape(-1) * x - sign * adjacent(x)
            y, x = out.reshape(len(x), length, n), x.reshape(len(x), length, n)
            y[:, 1:] -= sign * cost * x[:, :-1]
            y[:, :-1] -= sign * cost * x[:, 1:]
            return inside(out)

        tops, shapes = np.empty(n), np.empty((length, n))
        for at in range(0, n, 4096):
            own = np.eye(length) * diagonal[:, at : at + 4096].T[:, None, :] - sign * cost * (np.eye(length, k=1) + np.eye(length, k=-1))
            found, of = np.linalg.eigh(own)
            tops[at : at + 4096], shapes[:, at : at + 4096] = found[:, -1], of[:, :, -1].T

        def nearby(x: np.ndarray, values: np.ndarray) -> np.ndarray:
            """Each node's path of times, without edges, solved for the values, which are kept above the path's own."""
            out = np.empty((len(x), length, n))
            for y, r, value in zip(out, x.reshape(out.shape), values, strict=True):
                shift, c = np.maximum(value, tops + 1e-5 * scale), np.empty((length, n))
                for t in range(length):
                    pivot = shift - diagonal[t] - (sign * cost * c[t - 1] if t else 0.0)
                    c[t] = sign * cost / pivot
                    y[t] = (r[t] - (sign * cost * y[t - 1] if t else 0.0)) / pivot
                for t in range(length - 2, -1, -1):
                    y[t] -= c[t] * y[t + 1]
            return inside(out.reshape(x.shape))

        width = min(max(dims + 1, min(8, HELD // (8 * size))), space)
        start = np.random.default_rng(3).standard_normal((width, length, n)) * (1e-3 / np.sqrt(size))
        for k, i in enumerate(np.argsort(-tops, kind="stable")[: width // 2]):
            start[k, :, i] += shapes[:, i]
        values, vectors = extreme(apply, nearby, inside(start.reshape(width, size)), min(dims, space), space, scale)
    gains = {"diff": lambda x: coefficient * n + x, "laplacian": lambda x: x, "prod": lambda x: n * n * x}[method]
    every = sorted([(-round(gains(float(x)), 9), 1, k) for k, x in enumerate(values)] + [(-round(x, 9), 0, k) for x, k in flat])[:dims]
    made = [(np.arange(n), vectors[k].reshape(length, n)) if of else (np.full(n, n**-0.5), f[:, k]) for _, of, k in every]
    return spread_out(rows.sparkSession, rows, made, dims)


def line_degrees(length: int) -> np.ndarray:
    """How many neighbours each of `length` times has."""
    return np.r_[1.0, [2.0] * (length - 2), 1.0] if length > 1 else np.zeros(1)


def spread_out(spark: SparkSession, rows: DataFrame, found: list[tuple[np.ndarray, np.ndarray]], dims: int) -> DataFrame:
    """(t, i, ev) or (t, i, ev, dim) of vectors: (x of all nodes, f of all times) for f(t) x(i), or (nodes, u(t, node)) and 0 elsewhere."""
    out = None
    for k, (x, f) in enumerate(found):
        if f.ndim == 1:
            whole = np.outer(f, x).reshape(-1)
            sign = -1.0 if whole[np.argmax(np.round(np.abs(whole), 12))] < 0 else 1.0
            i = spark.createDataFrame(pa.table({"i": np.arange(len(x)), "x": x * sign}))
            t = spark.createDataFrame(pa.table({"t": np.arange(len(f)), "f": f}))
            part = rows.join(i, "i").join(F.broadcast(t), "t").select("t", "i", (F.col("x") * F.col("f")).alias("ev"))
        else:
            u = canonical(f.reshape(-1, 1))[:, 0]
            made = spark.createDataFrame(pa.table({"t": np.repeat(np.arange(len(f)), len(x)), "i": np.tile(x, len(f)), "x": u}))
            part = rows.join(made, ["t", "i"], "left").select("t", "i", F.coalesce("x", F.lit(0.0)).alias("ev"))
        part = part.withColumn("dim", F.lit(k).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out.drop("dim") if dims == 1 else out


def vector(method: str, adj: DataFrame, rows: DataFrame, times: DataFrame, n: int, length: int, beta: float = 1.0, cost: float = 1.0, normalized: bool = False, dense: int = 4096, dims: int = 1, local: int = 4_000_000) -> DataFrame:
    """(t, i, ev) or, with dims > 1, (t, i, ev, dim): the vector that a method sweeps.

    diff: top of 3(n + 2 beta) C - L; laplacian: second-smallest of L; prod: top of C L C; fast: see fast_vector.
    C is the complete graph's Laplacian at each t. A graph of several components is solved by them (see by_components). Up to `dense` rows of L the problem is solved on the driver
    (dense * dense numbers at most); beyond, it is iterated to a tolerance: up to `local` pairs (t, i) by vectors on the driver and entries on the
    executors (see beside_flat), normalized on the driver alone where L has no more than `local` entries and local / 40 rows, over relations otherwise.
    """
    if method == "fast":
        return fast_vector(adj, rows, n, length, beta, normalized=normalized)
    if method not in ("diff", "laplacian", "prod"):
        raise ValueError(f"unknown method {method}")
    cells = supra_laplacian(adj, rows, times, n, cost, normalized)
    coefficient = 3.0 * (n + 2.0 * beta)
    if n * length <= dense:
        x = np.zeros((n * length, n * length))
        own = cells.toPandas()
        np.add.at(x, (own["row"].to_numpy(), own["col"].to_numpy()), own["val"].to_numpy())
        c = np.kron(np.eye(length), n * np.eye(n) - np.ones((n, n)))
        m = {"diff": coefficient * c - x, "laplacian": -x, "prod": c @ x @ c.T}[method]
        values, vectors = np.linalg.eigh((m + m.T) / 2)
        skip = 1 if method == "laplacian" else 0
        found = canonical(vectors[:, ::-1][:, skip : skip + dims])
        t, i = np.divmod(np.arange(n * length), n)
        out = pd.concat([pd.DataFrame({"t": t, "i": i, "ev": found[:, k], "dim": k}) for k in range(dims)])
        made = rows.sparkSession.createDataFrame(out, "t long, i long, ev double, dim long")
        return made.drop("dim") if dims == 1 else made
    if not normalized and n <= NODES:
        found = by_components(method, adj, rows, n, length, cost, dims, local)
        if found is not None:
            return found
        if n * length <= local:
            return beside_flat(method, adj, rows, n, length, coefficient, cost, dims)
    cells = written(cells, "supra")
    size, skip = n * length, 1 if method == "laplacian" else 0
    width, wanted = max(8, skip + dims + 4), skip + dims
    bound = cells.groupBy("row").agg(F.sum(F.abs("val")).alias("s")).agg(F.max("s")).first()[0]
    scale = bound * n * n if method == "prod" else bound
    if size <= local // 40 and cells.count() <= local:
        times_l = sparse_product(cells.toArrow().to_pandas(), size)

        def complete(x: np.ndarray) -> np.ndarray:
            y = x.reshape(length, n, -1)
            return (n * y - y.sum(1, keepdims=True)).reshape(x.shape)

        apply = {"diff": lambda x: coefficient * complete(x) - times_l(x), "laplacian": lambda x: -times_l(x), "prod": lambda x: complete(times_l(complete(x)))}[method]
        found = canonical(greatest(Arrays(apply, np.random.default_rng(3).standard_normal((size, width))), width, wanted, size, 2000, scale=scale)[1])
        t, i = np.divmod(np.arange(size), n)
        out = pd.concat([pd.DataFrame({"t": t, "i": i, "ev": found[:, skip + k], "dim": k}) for k in range(dims)])
        made = rows.sparkSession.createDataFrame(out, "t long, i long, ev double, dim long")
        return made.drop("dim") if dims == 1 else made

    def product(x: DataFrame, m: int) -> DataFrame:
        return cells.join(x.withColumnRenamed("row", "col"), "col").groupBy("row").agg(dot("u", m, F.col("val")).alias("u"))

    def completed(x: DataFrame, m: int) -> DataFrame:
        x = x.withColumn("t", F.floor(F.col("row") / n))
        total = x.groupBy("t").agg(dot("u", m, F.lit(1.0)).alias("__sum"))
        return x.join(total, "t").select("row", F.zip_with("u", "__sum", lambda a, b: n * a - b).alias("u"))

    def difference(x: DataFrame, m: int) -> DataFrame:
        both = completed(x, m).join(product(x, m).withColumnRenamed("u", "__l"), "row")
        return both.select("row", F.zip_with("u", "__l", lambda a, b: coefficient * a - b).alias("u"))

    apply = {
        "diff": difference,
        "prod": lambda x, m: completed(product(completed(x, m), m), m),
        "laplacian": lambda x, m: product(x, m).select("row", F.transform("u", lambda a: -a).alias("u")),
    }[method]
    start = rows.select((F.col("t") * n + F.col("i")).alias("row"), F.array(*[F.randn(3 + k) for k in range(width)]).alias("u"))
    values, x = greatest(Relations(apply, start, ["row"], width), width, wanted, size, 2000, scale=scale)
    x = signed(x, ["row"], len(values)).select(F.floor(F.col("row") / n).alias("t"), (F.col("row") % n).alias("i"), "u")
    if dims == 1:
        return x.select("t", "i", F.col("u")[skip].alias("ev"))
    return x.select("t", "i", F.posexplode(F.slice("u", skip + 1, dims)).alias("dim", "ev")).select("t", "i", "ev", F.col("dim").cast("long").alias("dim"))


def widened(base: DataFrame, dims: int, seed: int = 7) -> DataFrame:
    """(t, i, emb): the vector and dims - 1 noisy copies, as the fast and prod methods widen theirs; seeded."""
    more: list[Column] = [F.col("ev") + 0.1 * F.randn(seed + k) for k in range(1, dims)]
    return base.select("t", "i", F.array(F.col("ev"), *more).alias("emb"))
