"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Coarse centroids and the codebooks are fitted on the driver on at most `sample` vectors (those whose hashed ids
are smallest); every vector is indexed. There are about four times as many lists as the root of the number of vectors,
and as many of them are probed as the sample itself needs for the wanted recall. Inverted lists are gathered into
blocks of a bounded number of rows: small lists share one, and a list that is too long, such as that of a vector which
a third of the rows hold, is salted over several. A query goes to each block that holds one of its lists, in chunks of
a bounded number of queries, to which the block's codes come, not its vectors; there an asymmetric distance table ranks
the codes. The best `rerank` of all blocks together are measured exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    draw = np.random.default_rng(seed)
    centres = x[draw.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        order = np.argsort(near, kind="stable")
        found, starts = np.unique(near[order], return_index=True)
        centres[found] = np.add.reduceat(x[order], starts) / np.diff(np.r_[starts, len(x)])[:, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, "int64")


class Index:
    """Coarse centroids (lists x dims) and codebooks (parts x 256 x dims of a part): a few megabytes at most."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int, seed: int = 11):
        self.coarse = kmeans(sample, min(lists, len(sample)), 8, seed)
        residual = sample - self.coarse[nearest(sample, self.coarse)]
        self.cuts = np.linspace(0, sample.shape[1], min(parts, sample.shape[1]) + 1).astype(int)
        self.books = [kmeans(residual[:, a:b], min(256, len(sample)), 6, seed) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists, codes, and what a vector adds to its distances whatever the query: |r|^2 + 2 c.r of its coded residual r."""
        near = nearest(x, self.coarse)
        residual = x - self.coarse[near]
        codes = np.column_stack([nearest(residual[:, a:b], book) for a, b, book in self.parts()]).astype("uint8")
        coded = np.hstack([book[codes[:, part]] for part, (_, _, book) in enumerate(self.parts())])
        return near, codes, ((coded + 2 * self.coarse[near]) * coded).sum(1).astype("float32")

    def parts(self) -> Iterator[tuple[int, int, np.ndarray]]:
        return zip(self.cuts, self.cuts[1:], self.books, strict=False)

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        apart = (self.coarse**2).sum(1) - 2 * x @ self.coarse.T
        return np.argsort(apart, axis=1, kind="stable")[:, :n]

    def table(self, query: np.ndarray) -> np.ndarray:
        """The asymmetric table of a query: -2 q.b for each part's entries b, 256 a part. A coded vector's squared distance
        is |q - c|^2 of its list, what it adds itself, and its codes' numbers from this table."""
        out = np.zeros((len(self.books), 256), "float32")
        for part, (a, b, book) in enumerate(self.parts()):
            out[part, : len(book)] = -2 * (book * query[a:b]).sum(1)
        return out.reshape(-1)

    def needed(self, sample: np.ndarray, k: int, target: float, asked: int = 256) -> int:
        """How many lists must be probed so that the sample's own first rows find `target` of their k nearest in the sample."""
        own = sample[:asked]
        apart = (sample**2).sum(1) - 2 * own @ sample.T
        apart[np.arange(len(own)), np.arange(len(own))] = np.inf
        true = np.argsort(apart, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
        place = np.argsort(self.probes(own, len(self.coarse)), axis=1)
        turns = np.sort(place[np.arange(len(own))[:, None], nearest(sample, self.coarse)[true]].reshape(-1))
        return int(turns[min(len(turns) - 1, int(target * len(turns)))]) + 1 if len(turns) else 1


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles): neither null nor zero, all components finite, of the table's most frequent length (ties: the smallest)."""
    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = found.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    length = found.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return found.where(F.size("embedding") == (length["n"] if length else 0))


def matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(len(column), -1)


def foremost(near: np.ndarray, ids: np.ndarray, numbers: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` nearest, ties by id and row, in no order."""
    if len(near) <= most:
        return np.arange(len(near))
    limit = np.partition(near, most - 1)[most - 1]
    under, level = np.flatnonzero(near < limit), np.flatnonzero(near == limit)
    return np.r_[under, level[np.lexsort((numbers[level], ids[level]))][: most - len(under)]]


def search(vectors: DataFrame, every: int = 100, k: int = 10, sample: int = 8192, lists: int | None = None, parts: int = 32, target: float = 0.97, rerank: int = 128, most: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query, a usable vector whose id is divisible by `every`, its k nearest other rows found.

    Euclidean distance in double precision; ties go to the smaller id. Repeated ids: each row is a candidate of its
    own, other than the query's id, and a query that is repeated is asked once (with the first of its vectors). Fewer
    usable rows than k + 1: all of them. Vectors of another length than the most frequent one take no part, as no
    distance to them is defined. An empty table, or one without usable vectors, gives no rows. lists: 4 sqrt(rows), at
    most 4,096, if none is given. target: the recall for which lists are probed, by the sample. most: queries in a chunk, on average.
    """
    spark = vectors.sparkSession
    good = usable(vectors)
    fitted = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not fitted:
        return spark.createDataFrame([], schema)
    fitted = np.array([r["embedding"] for r in fitted])
    index = Index(fitted, lists or int(min(4096, max(1, 4 * good.count() ** 0.5))), parts)
    n_lists = len(index.coarse)
    n_probes = min(n_lists, max(16, index.needed(fitted, k, target)))

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 40
        for rows in batches:
            if len(rows):
                x = np.stack(rows["embedding"].to_numpy())
                where, codes, own = index.encode(x)
                yield pd.DataFrame({"row": np.arange(number, number + len(rows)), "vec_id": rows["vec_id"], "list": where, "own": own, "code": [c.tobytes() for c in codes], "vector": [v.astype("<f8").tobytes() for v in x]})
                number += len(rows)

    rows = common.written(good.mapInPandas(coded, "row long, vec_id long, list int, own float, code binary, vector binary"), "index")
    counts = {r["list"]: r["count"] for r in rows.groupBy("list").count().collect()}  # one row a list, so at most `lists`
    size = max(2048, min(65_536, sum(counts.values()) // 48))
    blocks, at, room = {}, 0, 0
    for which in range(n_lists):
        n = counts.get(which, 0)
        salts = -(-n // size)
        if n and salts == 1:
            if n > room:
                at, room = at + 1, size
            blocks[which] = (at, 1)
            room -= n
        elif n:
            blocks[which] = (at + 1, salts)
            at, room = at + salts, 0
    table = spark.createDataFrame([(w, b, s) for w, (b, s) in blocks.items()], "list int, first int, salts int")
    queries = common.written(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector")).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query")), "queries")
    chunks = max(1, -(-queries.count() // most))
    held = rows.join(F.broadcast(table), "list").withColumn("block", F.expr("first + pmod(xxhash64(vec_id), salts)").cast("int"))
    held = held.select("block", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "list", "vec_id", "row", "own", "code")

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                probed = index.probes(matrix(part["query"]), n_probes)
                out = [sorted({b + s for w in own if w in blocks for b, n in (blocks[w],) for s in range(n)}) for own in probed.tolist()]
                times = [len(o) for o in out]
                yield pd.DataFrame({"query_id": np.repeat(part["query_id"].to_numpy(), times), "query": np.repeat(part["query"].to_numpy(), times), "block": [b for o in out for b in o]})

    sent = queries.mapInPandas(asked, "query_id long, query binary, block int").withColumn("chunk", F.expr(f"cast(pmod(xxhash64(query_id), {chunks}) as int)"))

    def ranked(asking: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(asking) and len(own):
            own = own.sort_values(["list", "vec_id", "row"], kind="stable")
            ids, numbers, adds = (own[c].to_numpy() for c in ("vec_id", "row", "own"))
            codes = np.frombuffer(b"".join(own["code"]), "uint8").reshape(len(own), -1) + 256 * np.arange(len(index.books))
            found, starts = np.unique(own["list"].to_numpy(), return_index=True)
            spans = dict(zip(found.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(own)], strict=True), strict=True))
            q = matrix(asking["query"])
            for query_id, query, probed in zip(asking["query_id"].to_numpy(), q, index.probes(q, n_probes).tolist(), strict=True):
                mine = [(w, *spans[w]) for w in probed if w in spans]
                if not mine:
                    continue
                place = np.concatenate([np.arange(a, b) for _, a, b in mine])
                base = ((index.coarse[[w for w, _, _ in mine]] - query) ** 2).sum(1)
                near = np.repeat(base, [b - a for _, a, b in mine]) + adds[place] + index.table(query)[codes[place]].sum(1)
                other = ids[place] != query_id
                place, near = place[other], near[other].astype("float32")
                first = foremost(near, ids[place], numbers[place], rerank)
                out.append((query_id, *(x.tobytes() for x in (near[first], ids[place[first]], numbers[place[first]]))))
        return pd.DataFrame(out, columns=["query_id", "near", "vec_id", "row"]) if out else pd.DataFrame({"query_id": np.zeros(0, "int64"), "near": [], "vec_id": [], "row": []})

    def merged(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        near, ids, numbers = (np.frombuffer(b"".join(part[c]), kind) for c, kind in (("near", "f4"), ("vec_id", "i8"), ("row", "i8")))
        first = foremost(near, ids, numbers, rerank)
        return near[first], ids[first], numbers[first]

    def fewer(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(part["query_id"].iloc[0], *(x.tobytes() for x in merged(part)))], columns=["query_id", "near", "vec_id", "row"])

    def chosen(part: pd.DataFrame) -> pd.DataFrame:
        _, ids, numbers = merged(part)
        return pd.DataFrame({"query_id": part["query_id"].iloc[0], "vec_id": ids, "row": numbers})

    keys, packed = ["block", "chunk"], "query_id long, near binary, vec_id binary, row binary"
    near, parts_ = sent.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(ranked, packed), at + 1
    while parts_ > 256:  # a query's lists of many blocks are merged by and by, 256 at most in a task
        near, parts_ = near.groupBy("query_id", F.expr(f"pmod(xxhash64(near, row), {-(-parts_ // 128)})")).applyInPandas(fewer, packed), -(-parts_ // 128)
    best = near.groupBy("query_id").applyInPandas(chosen, "query_id long, vec_id long, row long")

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                yield pd.DataFrame({"query_id": part["query_id"], "vec_id": part["vec_id"], "row": part["row"], "score": np.sqrt(((matrix(part["vector"]) - matrix(part["query"])) ** 2).sum(1))})

    exact = best.join(rows.select("row", "vector"), "row").join(queries, "query_id").mapInPandas(measured, "query_id long, vec_id long, row long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id", "row")).cast("int")
    return exact.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search() of all embeddings; awkward vectors and repeated ids as there; only vec_id and embedding are read."""
    return search(common.table(spark, sf_dir, "embeddings"))
