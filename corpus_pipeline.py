"""A corpus pipeline: low quality out, one document of each near-duplicate group, secrets covered, the rest packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, and
further columns that docs has, whatever their names. No stage fails on nulls in any column, on empty or very long texts,
on repeated rows or on an empty table, which gives an empty one; what each makes of them is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tempograph.llm import common, near_dedup, packing, quality, secret_scan


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones of them, does not reject.

    A null text is scored as the empty one, and stays null where it is kept; a row without an id has no label and is
    scored like any other; repeated rows are scored alike. Without labels all scores are one half, and all rows stay.
    """
    common.small_batches(spark)
    return quality.kept(docs, quality.train(docs, common.table(spark, sf_dir, "labels")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    Null and empty texts, and texts without words, are like no other and stay. Rows that share an id are one document
    and stay or go together; rows without an id stay.
    """
    common.small_batches(spark)
    return near_dedup.kept(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret that was found replaced by a mark, and n_chars to fit.

    Null texts stay null, texts without secrets as they are; repeated rows and rows without an id are covered like others.
    """
    common.small_batches(spark)
    return secret_scan.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in packed sequences; the encoder remembers less than it does alone, as workers also hold the other stages' tables.

    A null or empty text is one piece, the end id; ids may be null or repeat, and each row has pieces of its own.
    """
    common.small_batches(spark)
    return packing.packed(docs, common.tokenizer_path(), memo=300_000)


STAGES = [("quality classifier", quality_stage), ("MinHash near-dedup", dedup_stage), ("secret scan", secrets_stage), ("packing", packing_stage)]

#: The classifier cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; of the tables between stages, those that a later one has replaced are deleted."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            common.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
