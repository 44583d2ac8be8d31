"""BPE encoding and decoding of whole texts by tree concatenation (see bpe)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common


def op2_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return bpe.encode_texts(docs, common.tokenizer_path()).withColumnRenamed("id", "doc_id")
