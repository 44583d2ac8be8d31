"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE code points. Each passage is encoded from its own text: shares of
character classes and of hashed pairs of classes, repeated and distinct words, word lengths, and shares of hashed pairs
of neighbouring code points and of hashed words, which tell letters and words apart in every script. The encoding goes
through a learned hidden layer, and a gated attention layer gives the passage a weight (softmax over the bag of
w . (tanh(V h) * sigmoid(U h))); the weighted sum of the hidden vectors is scored by a logistic output. Only documents
have labels.

The model is fitted on the driver on at most `sample` labelled documents (those whose hashed ids are smallest), whole
ones, as many as together have at most `passages` passages; scoring takes all passages of all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PASSAGE = 600
CLASSES = 24
PAIRS = 64
LETTERS = 160
WORDS = 160
#: Where each group of numbers begins: classes, pairs of classes, five figures of words, pairs of code points, words.
FIGURES = CLASSES + PAIRS
LETTERS_FROM = FIGURES + 5
WORDS_FROM = LETTERS_FROM + LETTERS
SIZE = WORDS_FROM + WORDS


def class_table() -> np.ndarray:
    """A class for each Latin-1 code point, and one, at 256, for all others."""
    table = np.full(257, 22, "int64")
    for k, chars in enumerate((range(97, 123), range(65, 91), range(48, 58), (32,), (10, 13), (9,), (46,), (44,), (33,), (63,), (124,), (35,), (36,), (37,), (38,), (42,), (34, 39, 96), (40, 41, 60, 62, 91, 93, 123, 125), (58, 59), (43, 45, 47, 61, 92, 94, 95, 126, 64), (*range(223, 247), *range(248, 256)), (*range(192, 215), *range(216, 223)))):
        table[list(chars)] = k
    table[0:9] = 23
    return table


TABLE = class_table()
BUCKET = (np.arange(CLASSES * CLASSES) * 2654435761 % 2**32) >> 26


def letter_pairs(codes: np.ndarray) -> np.ndarray:
    """A bucket for each pair of neighbouring code points."""
    return ((codes[:-1] * np.uint32(2654435761) + codes[1:]) * np.uint32(2246822519) >> np.uint32(8)) % np.uint32(LETTERS)


class Buckets(dict):
    """A bucket for each word; the table starts anew when it has grown beyond 100,000."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        found = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORDS
        return found


WORD = Buckets()


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of SIZE numbers, one a passage, and the number of passages of each text (one at least)."""
    counts = np.array([max(1, -(-len(t) // PASSAGE)) for t in texts])
    x = np.zeros((counts.sum(), SIZE), "float32")
    at = 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        if t:
            codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
            kinds = TABLE[np.minimum(codes, 256)]
            row = np.arange(len(kinds)) // PASSAGE
            length = np.bincount(row, minlength=n)[:, None]
            x[at : at + n, :CLASSES] = np.bincount(row * CLASSES + kinds, minlength=n * CLASSES).reshape(n, CLASSES) / length
            pair = BUCKET[kinds[:-1] * CLASSES + kinds[1:]]
            x[at : at + n, CLASSES:FIGURES] = np.bincount(row[:-1] * PAIRS + pair, minlength=n * PAIRS).reshape(n, PAIRS) / length
            x[at : at + n, LETTERS_FROM:WORDS_FROM] = np.bincount(row[:-1] * LETTERS + letter_pairs(codes), minlength=n * LETTERS).reshape(n, LETTERS) / length
            for k in range(n):
                words = t[k * PASSAGE : (k + 1) * PASSAGE].split()
                total = max(1, len(words))
                repeats = sum(map(str.__eq__, words, words[1:]))
                x[at + k, FIGURES:LETTERS_FROM] = (repeats / total, len(set(words)) / total, len(words) / PASSAGE, length[k, 0] / PASSAGE, sum(map(str.isupper, words)) / total)
                x[at + k, WORDS_FROM:] = np.bincount([WORD[w] for w in words], minlength=WORDS) / total if words else 0
        at += n
    return x, counts


class Model:
    """Weights as arrays; a few tens of kilobytes, whatever the corpus."""

    def __init__(self, seed: int = 7, hidden: int = 32, gate: int = 16):
        draw = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(SIZE, "float32"), np.ones(SIZE, "float32")
        put = lambda *shape: (draw.standard_normal(shape) / np.sqrt(shape[0])).astype("float32")
        self.w = {"W": put(SIZE, hidden), "b": np.zeros(hidden, "float32"), "V": put(hidden, gate), "U": put(hidden, gate), "a": put(gate, 1), "c": np.zeros((hidden, 1), "float32"), "d": np.zeros(1, "float32")}

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        w, starts = self.w, np.r_[0, np.cumsum(counts)[:-1]]
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ w["W"] + w["b"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * s @ w["a"])[:, 0]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        alpha = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(h * alpha[:, None], starts)
        return {"x": x, "h": h, "t": t, "s": s, "alpha": alpha, "z": z, "p": 1 / (1 + np.exp(-np.clip((z @ w["c"] + w["d"])[:, 0], -30, 30)))}

    def gradient(self, f: dict, y: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        w, starts = self.w, np.r_[0, np.cumsum(counts)[:-1]]
        out = (f["p"] - y)[:, None] / len(y)
        dz = np.repeat(out @ w["c"].T, counts, axis=0)
        da = (dz * f["h"]).sum(1)
        de = f["alpha"] * (da - np.repeat(np.add.reduceat(da * f["alpha"], starts), counts))
        gated = de[:, None] * w["a"].T
        dt, ds = gated * f["s"] * (1 - f["t"] ** 2), gated * f["t"] * f["s"] * (1 - f["s"])
        dh = dz * f["alpha"][:, None] + dt @ w["V"].T + ds @ w["U"].T
        du = dh * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ du, "b": du.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "a": (f["t"] * f["s"]).T @ de[:, None], "c": f["z"].T @ out, "d": out.sum(0)}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, rounds: int = 12, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> Model:
        """Adam on the logistic loss. Without bags, the model stays as it is and scores one half."""
        if not bags:
            return self
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-3
        self.w["d"][:] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
        draw, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        for _ in range(rounds):
            order = draw.permutation(len(bags))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                counts = np.array([len(bags[i]) for i in own])
                g = self.gradient(self.forward(np.concatenate([bags[i] for i in own]), counts), y[own].astype("float32"), counts)
                step += 1
                for k, x in self.w.items():
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    x -= (rate * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + decay * x)).astype("float32")
        return self

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        parts = []
        for at in range(0, len(texts), 500):
            x, counts = encode(texts[at : at + 500])
            parts.append(self.forward(x, counts)["p"].astype("float64"))
        return np.concatenate(parts)


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 6000, passages: int = 32_000) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, <label> 0 or 1), rows of fold 0 and null ids or labels left out.

    A document that occurs more than once, or with labels that differ, gives the bag and label of each pairing. In the
    order of hashed ids a document is taken if the passages so far and its own are at most `passages`, so that the
    driver gets at most that many encodings (SIZE half-precision numbers each), whatever the texts' lengths.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & (fold_of(F.col("doc_id")) != 0))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of(docs).alias("text")).join(F.broadcast(known), "doc_id")
    size = F.greatest(F.lit(1), F.ceil(F.length("text") / PASSAGE))
    sizes = rows.select("doc_id", size.alias("n")).groupBy("doc_id", F.xxhash64("doc_id").alias("h")).agg(F.sum("n").alias("n")).collect()  # at most `sample` rows
    taken, total = [], 0
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        if total + r["n"] <= passages:
            taken.append((r["doc_id"],))
            total += r["n"]
    chosen = docs.sparkSession.createDataFrame(taken, "doc_id long")

    def bags(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x, counts = encode(part["text"].tolist())
            ends = np.cumsum(counts)
            own = [x[e - n : e].astype("float16").tobytes() for e, n in zip(ends, counts, strict=True)]
            yield pd.DataFrame({"doc_id": part["doc_id"], "y": part["y"], "x": own})

    found = rows.join(F.broadcast(chosen), "doc_id").mapInPandas(bags, "doc_id long, y int, x binary").collect()
    found.sort(key=lambda r: (r["doc_id"], r["y"], bytes(r["x"])))
    return Model().fit([np.frombuffer(r["x"], "float16").reshape(-1, SIZE).astype("float32") for r in found], np.array([r["y"] for r in found]))


def scorer(model: Model):
    """The model as a function of a text column.

    Null is the empty text, which is a bag of one empty passage; equal texts score alike; a model without any
    training rows scores one half.
    """

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(model.score(part.fillna("").tolist()))

    return score


def op4_quality_classifier(spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """One row a row; held_out is null without an id. An empty table gives none. Only doc_id and text are read."""
    docs = common.table(spark, sf_dir, "documents")
    score = scorer(train(docs, common.table(spark, sf_dir, "labels")))
    found = docs.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), score(common.text_of(docs)).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def kept(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents, all columns, that score at least the threshold; null text counts as empty."""
    return docs.where(scorer(model)(common.text_of(docs)) >= threshold)
