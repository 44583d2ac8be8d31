"""Token counts through a digest cache.

A text's count is stored under the digests of its normalised content and of the tokenizer's file. A call joins
its texts to the stored counts, encodes one carrier of each digest that is missing, and appends those counts.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common


@functools.lru_cache(maxsize=2)
def pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            texts = batch["text"].to_pylist()
            if path.endswith(".model"):
                counts = [len(x) for x in pieces(path).encode(texts, num_threads=1)]
            else:
                counts = [len(x) // 4 for x in bpe.encoder(path).encode(texts)]
            yield pa.RecordBatch.from_arrays([batch["content"], pa.array(counts, pa.int64())], ["content", "n_tokens"])

    return run


def normalised(text: Column, path: str) -> Column:
    """What can be taken away without a change of the count: runs of blanks, where the tokenizer drops white space; else nothing."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            if bpe.drops_blanks(json.load(f)):
                return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))
    return text


class CountCache:
    """Parquet rows (tokenizer, content, n_tokens) under `path`, a folder that all executors share."""

    SCHEMA = "tokenizer string, content binary, n_tokens long"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or common.new_path(spark, "counts")

    def rows(self, version: str) -> DataFrame:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path).where(F.col("tokenizer") == version)

    def count(self, docs: DataFrame, tokenizer: str) -> DataFrame:
        """(id, n_bytes, n_tokens) of docs(id, text), one row a row, repeated rows and null ids too; null text: empty, no tokens. An empty table gives no rows."""
        with open(tokenizer, "rb") as f:
            version = sha256(f.read()).hexdigest()
        text = common.text_of(docs)
        rows = docs.select("id", F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(normalised(text, tokenizer), 256)).alias("content"), text.alias("text"))
        missing = common.distinct_contents(rows, "content", self.rows(version))
        found = missing.mapInArrow(counted(tokenizer), "content binary, n_tokens long").dropDuplicates(["content"])
        found.select(F.lit(version).alias("tokenizer"), "content", "n_tokens").write.mode("append").parquet(self.path)
        known = self.rows(version).select("content", "n_tokens").dropDuplicates(["content"])
        return common.joined_back(rows.select("id", "n_bytes", "content"), "content", known).select("id", "n_bytes", "n_tokens")


def op3_token_counts(spark: SparkSession, sf_dir: str, limit: int = 2048) -> DataFrame:
    """One row a row of documents, through a cache that is new. Null text: no bytes, no tokens; null and repeated ids stay; an empty table gives none; only doc_id and text are read."""
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = CountCache(spark).count(docs, common.tokenizer_path())
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
