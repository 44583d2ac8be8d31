"""Near-duplicate groups by banded MinHash with odd sketches, confirmed on full shingle sets.

1. Each text gives its set of distinct word shingles as 64-bit hashes, a digest of the set, ROWS x BANDS MinHash
   samples, the bands' hashes, and an odd sketch: a bitmap in which each sample flips one bit. The more samples two
   sets share, the fewer bits differ; BITS log-corrected differing bits estimate high similarities closely.
2. Texts of equal sets are one class, whose smallest id stands for it; digests are pre-aggregated, so a group of
   copies costs a row a partition.
3. In each band's bucket, every class is a candidate of the bucket's centre, the first in one of CENTRES orders: as
   many pairs as members. Pairs whose sketches differ too much (five standard deviations beyond the threshold) go;
   the others are confirmed on full sets. Confirmed links give components by alternating stars.
4. A bucket whose classes are by now in one component needs no more. In the others, all that is outside the largest
   component is compared with all of the bucket, block by block: classes of different components, in the first
   bucket that they share. Blocks hold sketches alone at first, and tell which classes have a near one in them; only
   those come again, with their sets, and are compared set against set, the nearest first; a link joins components
   there and then, so that a block gives fewer links than it has members. So each candidate pair is either compared
   or already joined, no bucket is collected whole or expanded into its pairs, and a block's sets are bounded, as a
   bucket has more blocks the more shingles its classes have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BANDS, ROWS, BITS = 32, 4, 512
SAMPLES = BANDS * ROWS
BLOCK, CENTRES = 512, 8
#: Shingles of a block's classes on either side, on average; a class that has more is alone in its size.
SHINGLES = 1_000_000
_draw = np.random.default_rng(20240501)
ODD = _draw.integers(0, 2**63, 8, dtype="uint64") * np.uint64(2) + np.uint64(1)
A = (_draw.integers(0, 2**31, SAMPLES, dtype="uint64") * np.uint64(2) + np.uint64(1)).astype("uint32")
B = _draw.integers(0, 2**32, SAMPLES, dtype="uint64").astype("uint32")
SEEDS = _draw.integers(0, 2**63, SAMPLES, dtype="uint64")


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of x moves every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Hashes of words; the table starts anew when it has grown beyond 100,000."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        if len(self.known) > 100_000:
            self.known.clear()
        new = list(set(words).difference(self.known))
        self.known.update(zip(new, map(xxhash.xxh3_64_intdigest, new), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), "uint64", len(words))


WORDS = Words()


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of `words` words, A-Z lower-cased; of fewer words, the one hash of all; none without words."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, "uint64")
    x, n = WORDS.of(found), min(words, len(found))
    total = np.full(len(x) - n + 1, n * 0x9E3779B97F4A7C15 % 2**64, "uint64")
    for k in range(n):
        total += mixed(x[k : len(x) - n + 1 + k] + np.uint64(k)) * ODD[k % 8]
    return np.unique(mixed(total))


def samples(found: np.ndarray) -> np.ndarray:
    """SAMPLES minima, each under a permutation of its own of 32 bits."""
    x, low = (found >> np.uint64(32)).astype("uint32"), None
    for at in range(0, len(x), 2048):
        now = (np.multiply.outer(A, x[at : at + 2048]) + B[:, None]).min(axis=1)
        low = now if low is None else np.minimum(low, now)
    return low


def bands(low: np.ndarray) -> np.ndarray:
    x = mixed(low.astype("uint64") + SEEDS).reshape(BANDS, ROWS)
    return mixed((x * ODD[:ROWS]).sum(axis=1, dtype="uint64") + np.arange(BANDS, dtype="uint64")).view("int64")


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """BITS bits as 64-bit numbers: each sample flips the bit that its hash names."""
    bit = mixed(low.astype("uint64") ^ SEEDS) % np.uint64(BITS)
    parity = np.bincount(bit.astype("int64"), minlength=BITS).astype("uint8") & 1
    return np.packbits(parity, bitorder="little").view("int64")


def most_differing(similarity: float) -> int:
    """Differing bits of two sketches at `similarity`, and five standard deviations more."""
    apart = SAMPLES * (1 - similarity)
    deviation = 2 * np.sqrt(apart * similarity)
    expected = BITS / 2 * (1 - np.exp(-4 * apart / BITS))
    slope = 2 * np.exp(-4 * apart / BITS) / 2
    folding = np.sqrt(max(0.0, 2 * apart - expected))
    return int(np.ceil(expected + 5 * np.hypot(deviation * slope, folding)))


def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    names = ["id", "n_shingles", "content", "bands", "sketch"]
    for batch in common.slices(batches):
        out: list[list] = [[], [], [], []]
        for text in batch["text"].to_pylist():
            found = shingles(text)
            low = samples(found) if len(found) else None
            own = (len(found), xxhash.xxh3_128_digest(found.tobytes()), bands(low), odd_sketch(low)) if len(found) else (0, None, None, None)
            for column, x in zip(out, own, strict=True):
                column.append(x)
        kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch["id"], *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names)


def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches):
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array([shingles(t).tobytes() for t in batch["text"].to_pylist()], pa.binary())], ["id", "found"])


def linked(a: np.ndarray, b: np.ndarray, least: int) -> bool:
    """100 * intersection >= least * union, of two sets as sorted arrays."""
    if 100 * min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    place = np.searchsorted(a, b)
    both = int((a[np.minimum(place, len(a) - 1)] == b).sum())
    return 100 * both >= least * (len(a) + len(b) - both)


def confirmed(least: int):
    """Keeps the pairs that are links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            keep = [linked(np.frombuffer(a.as_buffer(), "uint64"), np.frombuffer(b.as_buffer(), "uint64"), least) for a, b in zip(batch["x"], batch["y"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def full_sets(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, found) for the wanted distinct ids, a written table; texts come in once for each row, so that repeated rows give repeated sets, which do no harm."""
    wanted = common.written(wanted, "wanted")
    found = common.written(common.of_ids(docs.select("id", "text"), wanted, "id").mapInArrow(sets, "id long, found binary"), "sets")
    common.drop(wanted)
    return found


def confirm(pairs: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) that are links by the full sets of docs(id, text). A class that is in many pairs is a skewed join's key, which Spark splits."""
    own = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), docs)
    x, y = own.select(F.col("id").alias("a"), F.col("found").alias("x")), own.select(F.col("id").alias("b"), F.col("found").alias("y"))
    links = common.written(pairs.select("a", "b").join(x, "a").join(y, "b").mapInArrow(confirmed(least), "a long, b long").distinct(), "links")
    common.drop(own)
    return links


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links as stars: each id with the smallest one that it reaches inside the partition."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    found = [(root(x), x) for x in list(parent)]
    found = [p for p in found if p[0] != p[1]]
    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(id, root) for each id in links(a, b) that has a smaller one in reach; root is the smallest.

    Partitions contract their links first; then large and small stars alternate until nothing changes. Each round's
    links are a written table; only a count and a checksum come to the driver.
    """
    edges, before = common.written(links.where("a <> b").mapInArrow(contracted, "a long, b long").distinct(), "stars"), None
    while True:
        edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("low").alias("a"), "b").where("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(low, "b").select(F.explode(F.array(F.struct(F.col("low").alias("a"), F.col("b").alias("b")), F.struct(F.col("low").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = common.written(small, "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("b").alias("id"), F.col("a").alias("root"))
        before = now


def near_pairs(rows: pd.DataFrame, i: int, j: int, limit: int) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """A block's two sides, and the numbers of the rows that are near by their sketches, of different components, and share no earlier bucket; with their differing bits."""
    left, right = (r.sort_values("id") for r in (rows[rows["block"] == i], rows[rows["block"] == j]))
    if not len(left) or not len(right):
        return left, right, *(np.zeros(0, "int64"),) * 3
    (x, m), (y, n) = ((np.stack(r["sketch"].to_numpy()).view("uint64"), np.stack(r["bands"].to_numpy())) for r in (left, right))
    differ = np.zeros((len(x), len(y)), "int32")
    for k in range(BITS // 64):
        differ += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
    a, b = np.nonzero((differ <= limit) & (left["root"].to_numpy()[:, None] != right["root"].to_numpy()[None, :]))
    if i == j:
        a, b = a[a < b], b[a < b]
    earlier = np.zeros(len(a), bool)
    for k in range(int(rows["number"].iloc[0])):
        earlier |= m[a, k] == n[b, k]
    a, b = a[~earlier], b[~earlier]
    return left, right, a, b, differ[a, b]


def surviving(limit: int):
    """The classes of a block of a bucket that have a near one in it: rows (band, number, i, j, id, block, root, sketch, bands)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left, right, a, b, _ = near_pairs(rows, *key[1:], limit)
        ids = np.unique(np.r_[left["id"].to_numpy()[a], right["id"].to_numpy()[b]])
        return rows.loc[rows["id"].isin(ids), ["band", "number", "i", "j", "id", "block", "root", "sketch", "bands"]]

    return run


def compared(limit: int, least: int):
    """The links that a block of a bucket adds: surviving rows, with sketch, bands and found."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left, right, a, b, differ = near_pairs(rows, *key[1:], limit)
        order = np.argsort(differ, kind="stable")
        parent: dict[int, int] = {}

        def root(k: int) -> int:
            while (up := parent.get(k, k)) != k:
                k = up
            return k

        sets = [[np.frombuffer(f, "uint64") for f in r["found"]] for r in (left, right)]
        roots = [r["root"].to_numpy() for r in (left, right)]
        found = []
        for u, v in zip(a[order].tolist(), b[order].tolist(), strict=True):
            p, q = root(roots[0][u]), root(roots[1][v])
            if p != q and linked(sets[0][u], sets[1][v], least):
                parent[max(p, q)] = min(p, q)
                found.append((left["id"].iloc[u], right["id"].iloc[v]))
        return pd.DataFrame(found, columns=["a", "b"]) if found else pd.DataFrame({"a": np.zeros(0, "int64"), "b": np.zeros(0, "int64")})

    return run


def groups(docs: DataFrame, least: int = 75) -> DataFrame:
    """(id, n_shingles, component_id) of docs(id, text), one row a row: linked where 100 * intersection >= least * union.

    Null and empty texts, and texts without words, have no shingles and are linked with nothing. Repeated rows are
    copies; rows that share an id are one document. A row without an id belongs to its copies' component, or to
    null. An empty table gives none.
    """
    docs = docs.select(F.col("id").cast("long").alias("id"), common.text_of(docs).alias("text"))
    rows = common.written(docs.mapInArrow(signed, "id long, n_shingles long, content binary, bands array<long>, sketch array<long>"), "signatures")
    classes = rows.where("n_shingles > 0").groupBy("content").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("size"))
    classes = common.written(classes, "classes")
    sketches = classes.select("id", "sketch")
    buckets = classes.select("id", "size", F.posexplode("bands").alias("number", "band"))
    first = F.struct(F.xxhash64("id", F.col("number") % CENTRES), F.col("id"))
    shared = buckets.groupBy("band").agg(F.min(first)["id"].alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = buckets.join(shared, "band").where("id <> a").select(F.least("id", "a").alias("a"), F.greatest("id", "a").alias("b")).distinct()
    limit = most_differing(least / 100)
    near = stars.join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("y")), "b").join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("x")), "a")
    near = common.written(near.where(F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n) <= limit).select("a", "b"), "near")
    links = confirm(near, docs, least)
    common.drop(near)
    roots = components(links)

    def rooted(df: DataFrame) -> DataFrame:
        return df.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))

    placed = rooted(buckets)
    parts = placed.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    open_ = parts.groupBy("band").agg(F.max(F.struct("n", "root", "size")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("parts")).where("n > 2 and parts > 1")
    blocks_of = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / SHINGLES)).cast("int")
    open_ = open_.select("band", F.col("main.root").alias("main"), blocks_of(F.col("main.n"), F.col("main.size")).alias("n_main"), blocks_of(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("n_other"))
    block = F.expr("cast(if(root = main, -1 - pmod(xxhash64(id, band), n_main), pmod(xxhash64(id, band), n_other)) as int)")
    dealt = common.written(placed.join(open_, "band").withColumn("block", block), "open")
    if not dealt.isEmpty():
        blocks = dealt.withColumn("with", F.explode(F.expr("concat(sequence(0, n_other - 1), if(block < 0, array(), sequence(-n_main, -1)))")))
        blocks = blocks.select("band", "number", "id", "root", "block", F.expr("if(block < 0 or with >= 0 and with < block, with, block)").alias("i"), F.expr("if(block < 0 or with >= 0 and with < block, block, with)").alias("j"))
        marks, keys = classes.select("id", "sketch", "bands"), ["band", "i", "j"]
        kinds = "band long, number int, i int, j int, id long, block int, root long, sketch array<long>, bands array<long>"
        near = common.written(blocks.join(marks, "id").groupBy(*keys).applyInPandas(surviving(limit), kinds), "surviving")
        own = full_sets(near.select("id").distinct(), docs)
        more = near.join(own, "id").groupBy(*keys).applyInPandas(compared(limit, least), "a long, b long")
        roots = components(common.written(links.unionByName(more), "links"))
        common.drop(near)
        common.drop(own)
    common.drop(dealt)
    heads = rooted(classes.select("content", "id")).select("content", F.col("root").alias("component_id"))
    return common.joined_back(rows.select("id", "n_shingles", "content"), "content", heads).select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """groups() of all documents: one row a row; null, empty and repeated rows as there; only doc_id and text are read."""
    found = groups(common.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def kept(docs: DataFrame) -> DataFrame:
    """The documents, all columns, whose id is their group's smallest; of repeated rows all stay, and so do rows without an id."""
    found = groups(docs.select(F.col("doc_id").alias("id"), "text")).where("id is not null").groupBy(F.col("id").alias("doc_id")).agg(F.max(F.col("id") == F.col("component_id")).alias("stays"))
    return common.not_of_ids(docs, common.written(found.where("not stays").select("doc_id"), "dropped"), "doc_id")
