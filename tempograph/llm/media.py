"""Media columns: payloads kept as lossless WebP pictures, read back into pixel arrays, with features of them.

A payload is padded to rows of ROW samples, three a pixel. A picture has at most MOST rows; a longer payload is a
run of files, one after the other, of which one at a time is in memory beside the payload.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, webp

ROW, WIDTH, MOST = 576, 192, 4096


def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % ROW or (0 if raw else ROW))


def store(payload: bytes) -> bytes:
    """Files of a payload of whole rows."""
    step = ROW * MOST
    return b"".join(webp.encode_payload(np.frombuffer(payload[at : at + step], "uint8"), WIDTH) for at in range(0, len(payload), step))


def load(media: bytes) -> Iterator[np.ndarray]:
    """The pictures of a run of files, as height x width numbers 0xAARRGGBB."""
    at = 0
    while at < len(media):
        size = 8 + struct.unpack_from("<I", media, at + 4)[0]
        yield webp.decode(media[at : at + size])
        at += size


def samples(x: np.ndarray) -> bytes:
    """A picture's red, green and blue samples in order."""
    return x.astype(">u4").view("uint8").reshape(*x.shape, 4)[..., 1:].tobytes()


def features(payload: bytes) -> str:
    """Rows, the channels' means, the samples' entropy in bits, and a 32-bit difference hash of 33 stretches' means; of pixel arrays alone."""
    x = np.frombuffer(payload, "uint8")
    counts = np.bincount(x, minlength=256)
    share = counts[counts > 0] / len(x)
    means = x.reshape(-1, 3).mean(axis=0)
    stretches = np.add.reduceat(x, np.arange(33) * len(x) // 33, dtype="int64") * 33 // len(x)
    difference = np.packbits(np.diff(stretches) > 0).tobytes().hex()
    return f"{len(x) // ROW};{means[0]:.4f},{means[1]:.4f},{means[2]:.4f};{-(share * np.log2(share)).sum():.4f};{difference}"


def stored(docs: DataFrame) -> DataFrame:
    """(id, n_bytes, media) of docs(id, text): the text's UTF-8, null as empty, as lossless pictures; one row a row, repeated rows too, ids may be null. An empty table gives none; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(kept, common.slices(batches))

    return docs.select("id", common.text_of(docs).alias("text")).mapInArrow(run, "id long, n_bytes long, media binary")


def kept(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(id, n_bytes, media) of a batch (id, text)."""
    raw = [t.as_buffer().to_pybytes() for t in batch["text"]]
    return pa.RecordBatch.from_arrays([batch["id"], pa.array([len(x) for x in raw], pa.int64()), pa.array([store(padded(x)) for x in raw], pa.binary())], ["id", "n_bytes", "media"])


READ = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(media: DataFrame) -> DataFrame:
    """media(id, n_bytes, media) with the payload's digests and features, all from the decoded pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(opened, common.slices(batches))

    return media.mapInArrow(run, READ)


def opened(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows of read_back() of a batch (id, n_bytes, media)."""
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    out: list[list] = [[] for _ in names[2:]]
    for m in batch["media"]:
        raw = m.as_buffer().to_pybytes()
        payload = b"".join(map(samples, load(raw)))
        for column, x in zip(out, (len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), sha256(raw).hexdigest(), features(payload)), strict=True):
            column.append(x)
    return pa.RecordBatch.from_arrays([batch["id"], batch["n_bytes"], *(pa.array(c, pa.int64() if k in ("payload_bytes", "tail_crc32", "media_bytes") else pa.string()) for c, k in zip(out, names[2:], strict=True))], names)


def stored_and_read_back(docs: DataFrame) -> DataFrame:
    """read_back(stored(docs)), the files of a batch read by the worker that made them instead of going through Spark to another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (opened(files) for batch in common.slices(batches) for files in common.slices(iter([kept(batch)])))

    return docs.select("id", common.text_of(docs).alias("text")).mapInArrow(run, READ)


def op9_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' texts through stored_and_read_back(): one row a row; null text: empty, a payload of padding alone; null and repeated ids stay; an empty table gives none; only doc_id and text are read."""
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return stored_and_read_back(docs).withColumnRenamed("id", "doc_id")
