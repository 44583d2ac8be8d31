import pytest
from pyspark.sql import functions as F

from awkward import SCHEMA, TEXTS, words


@pytest.fixture
def documents(spark):
    """Rows of every awkward kind, with ids that repeat with their text, one null id, and further columns named as operators name theirs."""
    rows = [(k, t, None if k % 3 == 0 else "en", "src0" if k % 2 else None, None if t is None else len(t), -k, "b", k, 1, 0, "s") for k, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], (None, words(1, 200), None, None, None, 0, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def tables(spark, documents, tmp_path):
    """A folder with documents and labels for queries."""
    documents.write.parquet(f"file://{tmp_path}/documents.parquet")
    labels = documents.where(F.col("doc_id").isNotNull()).select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic")).unionByName(spark.createDataFrame([(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int"))
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    return f"file://{tmp_path}"


@pytest.fixture
def no_rows(spark, empty, tmp_path):
    empty.write.parquet(f"file://{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/none/labels.parquet")
    return f"file://{tmp_path}/none"
