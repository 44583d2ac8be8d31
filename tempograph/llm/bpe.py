"""Byte-pair encoding: an exact memo over white-space chunks, and tree concatenation for long texts.

Tree concatenation cuts a long text at any place, encodes the pieces in parallel and joins neighbours: a window
around the join is encoded and grows until it agrees with the left piece and with the right one. Agreement means
a boundary between pre-tokens that both have (pre-tokens are found from left to right without memory, so from a
shared boundary on, all goes the same way), or, inside a pre-token too long to have one, a run of equal tokens
(a sequence of tokens is the encoding of its text if each neighbouring pair is, so that tokens of both sides may
be spliced where they share one).
"""

from __future__ import annotations

import functools
import gc
import json
import operator
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Letters and punctuation for which lower case and NFC act on each character alone; no apostrophe, no digit.
SIMPLE = re.compile(r"^(([A-Za-zÀ-ÖØ-öø-ÿ]{1,200})([!-&(-/:-@\[-`{-~]*))$", re.MULTILINE)
AGREE = 8


class Encoder:
    """Ids of texts, as the library gives them with add_special_tokens=False and no truncation or padding.

    If the tokenizer drops white space and looks at nothing beyond it, a text's ids are the ids of its chunks
    between blanks, which are remembered in two tables (whole chunks; lower-cased letter runs). A table that has
    grown beyond `limit` entries, or 0.7 of that for letter runs, some hundred megabytes, starts anew.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.by_chunk = drops_blanks(config)
        self.limit = limit
        special = {t["id"] for t in config["added_tokens"]}
        self.ends = np.array([n.endswith("</w>") or i in special for i, n in enumerate(self.names)])
        del self.names  # most uses need the ends only
        self.chunks: dict[str, bytes] = {"": b""}
        self.stems: dict[str, bytes] = {"": b""}

    @functools.cached_property
    def names(self) -> list[str]:
        return [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size())]

    @functools.cached_property
    def digits(self) -> list[str]:
        return [str(i) for i in range(self.tok.get_vocab_size())]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if not self.by_chunk:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        out, collects = [], gc.isenabled()
        gc.disable()  # many short-lived objects, and no cycles among them
        try:
            for group in groups(texts, 1 << 21):
                cut = [lowered(t).replace("\n", " ").split(" ") for t in group]
                if len(self.chunks) > self.limit:
                    self.chunks = {"": b""}
                if new := set().union(*cut).difference(self.chunks):
                    self.learn(new)
                get = self.chunks.__getitem__
                out += [b"".join(map(get, words)) for words in cut]
        finally:
            if collects:
                gc.enable()
        return out

    def learn(self, new: set[str]) -> None:
        """Enter new chunks. Those of letters and punctuation are made of their two parts' ids; all steps but the library's go over whole lists."""
        if len(self.stems) > 0.7 * self.limit:
            self.stems = {"": b""}
        found = SIMPLE.findall("\n".join(new))
        wholes = [f[0] for f in found]
        stems, tails = "\n".join([f[1] for f in found]).lower().split("\n"), [f[2] for f in found]
        if missing := list(set(stems).difference(self.stems)):
            ids = np.array(self.tok.encode_batch_fast([" ".join(missing)], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) != len(missing):
                raise AssertionError("a run of letters must be one pre-token")
            raw = ids.tobytes()
            stops = stops.tolist()
            self.stems.update(zip(missing, map(raw.__getitem__, map(slice, [0, *stops], stops)), strict=False))
        rest = [*new.difference(wholes), *(marks := list(set(tails).difference(self.stems)))]
        for w, e in zip(rest, self.tok.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.chunks[w] = np.array(e.ids, "<u4").tobytes()
        self.stems.update((p, self.chunks[p]) for p in marks)
        get = self.stems.__getitem__
        self.chunks.update(zip(wholes, map(operator.add, map(get, stems), map(get, tails)), strict=True))

    def decode(self, ids: list[int]) -> str:
        """As decode(ids, skip_special_tokens=False): of a tokenizer without decoder, the tokens joined by blanks."""
        return " ".join(map(self.names.__getitem__, ids)) if self.tok.decoder is None else self.tok.decode(ids, skip_special_tokens=False)

    def spans(self, text: str) -> np.ndarray:
        """Rows (id, start, end) in code points of one piece of text."""
        e = self.tok.encode(text, add_special_tokens=False)
        return np.column_stack([np.array(e.ids, "int64").reshape(-1, 1), np.array(e.offsets, "int64").reshape(-1, 2)])

    def join(self, text: str, left: np.ndarray, right: np.ndarray, begin: int, mid: int, end: int, window: int = 64) -> np.ndarray:
        """The spans of text[begin:end] from those of text[begin:mid] and text[mid:end]."""
        while True:
            a, b = max(begin, mid - window), min(end, mid + window)
            if a == begin and b == end:
                break
            w = self.spans(text[a:b]) + [0, a, a]
            i = (0, 0) if a == begin else self.meeting(left, w, a, mid)
            j = (len(right), len(w)) if b == end else self.meeting(right, w, mid, b, last=True)
            if i and j and i[1] <= j[1]:
                return np.concatenate([left[: i[0]], w[i[1] : j[1]], right[j[0] :]])
            window *= 2
        return self.spans(text[begin:end]) + [0, begin, begin]

    def meeting(self, x: np.ndarray, w: np.ndarray, low: int, high: int, last: bool = False) -> tuple[int, int] | None:
        """Numbers of tokens of x and of w before a place strictly between low and high where both agree; the first, or the last."""
        same = np.flatnonzero(self.ends[x[:-1, 0]] & (x[:-1, 2] > low) & (x[1:, 1] < high)) + 1
        here = np.flatnonzero(self.ends[w[:-1, 0]] & (w[:-1, 2] > low) & (w[1:, 1] < high)) + 1
        both = np.intersect1d(x[same, 1], w[here, 1]) if len(same) and len(here) else []
        if len(both):
            p = both[-1] if last else both[0]
            return int(same[np.searchsorted(x[same, 1], p)]), int(here[np.searchsorted(w[here, 1], p)])
        known = {(t, s): k for k, (t, s, e) in enumerate(x.tolist()) if s > low and e < high}
        pairs = [(known[t, s], k) for k, (t, s, _) in enumerate(w.tolist()) if (t, s) in known]
        run = [pairs[k + AGREE // 2] for k in range(len(pairs) - AGREE + 1) if pairs[k + AGREE - 1] == (pairs[k][0] + AGREE - 1, pairs[k][1] + AGREE - 1)]
        return run[-1 if last else 0] if run else None

    def tree(self, text: str, pieces: list[np.ndarray], cuts: list[int]) -> np.ndarray:
        """Join neighbours, then the joined, until one is left. cuts: where the pieces begin, and the end."""
        while len(pieces) > 1:
            joined = [self.join(text, pieces[k], pieces[k + 1], cuts[k], cuts[k + 1], cuts[k + 2]) for k in range(0, len(pieces) - 1, 2)]
            pieces, cuts = joined + pieces[2 * len(joined) :], [*cuts[::2], *([] if len(cuts) % 2 else cuts[-1:])]
        return pieces[0]


def lowered(text: str) -> str:
    """In lower case, so that fewer chunks differ, if that cannot matter: up to U+00FF each letter changes alone and NFC nothing; special strings must stay as they are."""
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def drops_blanks(config: dict) -> bool:
    """Whether white space is dropped and nothing looks across it, by the tokenizer's own description."""
    normal = config.get("normalizer") or {}
    steps = normal.get("normalizers", [normal] if normal else [])
    pre = config.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    return (
        all(n["type"] in ("NFC", "Lowercase") or n.get("pattern") == {"Regex": r"\s+"} and n["content"] == " " for n in steps)
        and (first.get("type"), first.get("behavior"), first.get("invert")) == ("Split", "Removed", True)
        and r"[^\s" in first["pattern"].get("Regex", "")
        and not any(t["lstrip"] or t["rstrip"] or t["normalized"] or " " in t["content"] for t in config["added_tokens"])
        and config["model"].get("end_of_word_suffix") == "</w>"
    )


def folded(spans: np.ndarray) -> bytes:
    """Spans in 8 bytes a token: all ids, then the steps between starts, then the lengths, each below 2**16."""
    starts, lengths = np.diff(spans[:, 1], prepend=0), spans[:, 2] - spans[:, 1]
    return spans[:, 0].astype("<u4").tobytes() + starts.astype("<u2").tobytes() + lengths.astype("<u2").tobytes()


def unfolded(raw: bytes) -> np.ndarray:
    n = len(raw) // 8
    starts = np.cumsum(np.frombuffer(raw, "<u2", n, 4 * n).astype("int64"))
    return np.column_stack([np.frombuffer(raw, "<u4", n).astype("int64"), starts, starts + np.frombuffer(raw, "<u2", n, 6 * n)])


def groups(texts: list[str], most: int) -> Iterator[list[str]]:
    """The texts in order, in lists of at most about `most` characters."""
    own, size = [], 0
    for t in texts:
        own.append(t)
        size += len(t)
        if size >= most:
            yield own
            own, size = [], 0
    if own:
        yield own


@functools.lru_cache(maxsize=2)
def encoder(path: str, limit: int = 1_000_000) -> Encoder:
    """One encoder a worker process, kept from task to task."""
    return Encoder(path, limit)


def encode_texts(docs: DataFrame, tokenizer: str, decode: bool = True, leaf: int = 32_768) -> DataFrame:
    """(id, n_tokens, ids, decoded) of docs(id, text): ids as little-endian unsigned 32-bit numbers in a binary, or, with decode, their digests.

    With decode: (id, n_tokens, ids_sha256, decoded_sha256). Null or empty text: no tokens and the digests of
    nothing. Each row gives a row, repeated rows and null ids too; an empty table gives none. Texts over `leaf` (below 2**16) characters go by tree concatenation:
    their pieces are dealt out, encoded in parallel, and joined where the text's pieces meet again.
    """
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if decode else "id long, n_tokens long, ids binary"

    def result(coder: Encoder, keys: list, encoded: list[bytes]) -> pa.RecordBatch:
        from hashlib import sha256

        counts = [len(x) // 4 for x in encoded]
        if not decode:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(encoded, pa.binary())], ["id", "n_tokens", "ids"])
        lists = (np.frombuffer(x, "<u4").tolist() for x in encoded)
        digests = [(sha256(" ".join(map(coder.digits.__getitem__, ids)).encode()).hexdigest(), sha256(coder.decode(ids).encode()).hexdigest()) for ids in lists]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array([d[0] for d in digests], pa.string()), pa.array([d[1] for d in digests], pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in common.slices(batches):
            if batch.num_rows:
                yield result(coder, batch["id"].to_pylist(), coder.encode(batch["text"].to_pylist()))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            for row in batch.to_pylist():
                found = folded(coder.spans(row["piece"]))
                yield pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in (("id", pa.int64()), ("copy", pa.int64()), ("k", pa.int32()), ("piece", pa.string()))] + [pa.array([found], pa.binary())], ["id", "copy", "k", "piece", "spans"])

    def whole(pieces: pd.DataFrame) -> pd.DataFrame:
        coder, pieces = encoder(tokenizer), pieces.sort_values("k")
        text, cuts = "".join(pieces["piece"]), np.cumsum([0, *pieces["piece"].str.len()]).tolist()
        spans = [unfolded(x) + [0, at, at] for x, at in zip(pieces["spans"], cuts, strict=False)]
        ids = coder.tree(text, spans, cuts)[:, 0].astype("<u4").tobytes()
        key = pieces["id"].iloc[0]
        return result(coder, [None if pd.isna(key) else int(key)], [ids]).to_pandas()

    rows = docs.select("id", F.coalesce("text", F.lit("")).alias("text"))
    near = rows.where(F.length("text") <= leaf).mapInArrow(short, schema)
    starts = F.sequence(F.lit(0), ((F.length("text") - 1) / leaf).cast("int"))
    far = rows.where(F.length("text") > leaf).withColumn("copy", F.monotonically_increasing_id())
    far = far.select("id", "copy", "text", F.explode(starts).alias("k")).select("id", "copy", "k", F.expr(f"substring(text, k * {leaf} + 1, {leaf})").alias("piece")).repartition("id", "copy", "k")
    far = far.mapInArrow(leaves, "id long, copy long, k int, piece string, spans binary").groupBy("id", "copy").applyInPandas(whole, schema)
    return near.unionByName(far)
