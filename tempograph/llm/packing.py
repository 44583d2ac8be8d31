"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

A document is cut at multiples of the window; whole windows stand alone. The remainders are dealt by the hash of a
number that each piece gets when it is written and shares with no other, so that groups have a bounded size whatever
ids are null or repeat, and a group's windows are found in one task whatever the corpus's size. Each group is divided into as few windows as hold it: the two partial partitions with the greatest imbalance are
merged, the heaviest window of one onto the lightest of the other, until one is left. If a window exceeds the
capacity, the division starts again with more windows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: With the number that deals a piece.
NUMBERED = f"{PIECES}, piece long"


def differencing(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number of each size, and the windows' sums.

    A partial partition is (sums, descending; the tree of members for each window). Trees are numbered: 1..n are
    the sizes, 0 is empty, and a merge makes new numbers with two children.
    """
    n = len(sizes)
    heap: list[tuple] = []
    for k, size in enumerate(sizes.tolist()):
        sums, trees = np.zeros(windows, "int64"), np.zeros(windows, "int64")
        sums[0], trees[0] = size, k + 1
        heap.append((-size, k, sums, trees))
    heapq.heapify(heap)
    children: list[np.ndarray] = []
    made, turn = n + 1, n
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        b, y = b[::-1], y[::-1]
        both = (x > 0) & (y > 0)
        trees = np.maximum(x, y)
        if count := int(both.sum()):
            children.append(np.column_stack([x[both], y[both]]))
            trees[both] = np.arange(made, made + count)
            made += count
        sums = a + b
        order = np.argsort(-sums, kind="stable")
        sums, trees = sums[order], trees[order]
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), turn, sums, trees))
        turn += 1
    _, _, sums, trees = heap[0]
    window = np.full(made, -1, "int64")
    window[trees] = np.arange(windows)
    window[0] = -1
    pairs = np.concatenate(children) if children else np.zeros((0, 2), "int64")
    for k in range(len(pairs) - 1, -1, -1):
        window[pairs[k]] = window[n + 1 + k]
    return window[1 : n + 1], sums


def divide(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window number of each size, no window above the capacity, near as few windows as can be. Sizes are at most the capacity."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while windows < len(sizes):
        where, sums = differencing(sizes, windows)
        if sums[0] <= capacity:
            return where
        windows += 1
    return np.arange(len(sizes))


def pack(pieces: DataFrame, capacity: int, group: int = 512) -> DataFrame:
    """pieces with sequence_id and offset. pieces: NUMBERED, or PIECES of a written table, whose rows are numbered here;
    any length from 1 to the capacity; ties and repeated rows stay rows of their own; no pieces give no rows.

    group: the mean number of pieces that are divided together; as their numbers differ, a group has hardly more than
    that (of 10**9 groups of 512 none is expected beyond 700), which bounds a task's memory and time.
    """
    if "piece" not in pieces.columns:
        pieces = pieces.withColumn("piece", F.monotonically_increasing_id())
    groups = max(1, -(-pieces.where(F.col("length") < capacity).count() // group))
    # beside nulls, pandas would hold other ids as floats
    dealt = pieces.withColumn("g", F.expr(f"pmod(xxhash64(piece), {groups})")).withColumn("none", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["none", "doc_id", "start", "length", "ids_crc32", "piece"], kind="stable")
        sizes = rows["length"].to_numpy()
        full = sizes >= capacity
        where = np.empty(len(rows), "int64")
        where[~full] = divide(sizes[~full], capacity) if (~full).any() else 0
        where[full] = np.arange(full.sum()) + len(rows)
        order = np.argsort(where, kind="stable")
        rows, where = rows.iloc[order], where[order]
        ends = np.cumsum(rows["length"].to_numpy())
        first = np.r_[True, where[1:] != where[:-1]]
        begins = ends - rows["length"].to_numpy()
        rows["offset"] = begins - np.repeat(begins[first], np.diff(np.r_[np.flatnonzero(first), len(rows)]))
        rows["sequence_id"] = rows["g"] * 2**32 + where
        return rows.drop(columns=["g", "piece"])

    found = dealt.groupBy("g").applyInPandas(one, f"{PIECES}, none boolean, offset long, sequence_id long")
    return found.select(F.expr("if(none, null, doc_id)").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def cut(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, memo: int) -> DataFrame:
    """NUMBERED pieces of docs(doc_id, text): each text's ids and then end_id, cut at multiples of the capacity. Null or empty text: the end id alone.

    A piece's number is its task's number and its place in the task's output; the pieces must be written before use.

    memo: entries that an encoder remembers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, last, step = bpe.encoder(tokenizer, memo), np.array([end_id], "<u4").tobytes(), 4 * capacity
        number = TaskContext.get().partitionId() << 40
        for batch in common.slices(batches):
            out: list[list] = [[], [], [], [], []]
            for doc, ids in zip(batch["doc_id"].to_pylist(), coder.encode(batch["text"].to_pylist()), strict=True):
                ids += last
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    for column, value in zip(out, (doc, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4), strict=True):
                        column.append(value)
            out.append(range(number, number + len(out[0])))
            number += len(out[0])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "piece"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of(docs).alias("text")).mapInArrow(run, NUMBERED)


def packed(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, memo: int = 1_500_000) -> DataFrame:
    """docs(doc_id, text, ...) as packed pieces; null ids are kept, other columns are not read, an empty table gives no pieces. The pieces, a few numbers each, are written once, so that no text is encoded twice."""
    return pack(common.written(cut(docs, tokenizer, capacity, end_id, memo), "pieces"), capacity)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed pieces. Null or empty text: one piece, the end id; null and repeated ids stay; an empty table gives none; only doc_id and text are read."""
    return packed(common.table(spark, sf_dir, "documents"), common.tokenizer_path())
