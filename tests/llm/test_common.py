import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tempograph.llm import common


@pytest.mark.parametrize("words", [1, 3, 1 << 20])
def test_rows_of_ids_and_others(spark, monkeypatch, words):
    """With few words nearly all marks are set, and the rows are the same."""
    monkeypatch.setattr(common, "MARK_WORDS", words)
    rows = [(k, f"t{k}", k % 7, -k) for k in range(-300, 300)] + [(5, "again", 0, 0), (None, "none", None, None)]
    df = spark.createDataFrame(rows, "id long, text string, __word long, __BIT long")
    ids = common.written(df.where("id % 3 = 0").select("id").unionByName(spark.createDataFrame([(10**12,)], "id long")), "ids")
    found, others = common.of_ids(df, ids, "id"), common.not_of_ids(df, ids, "id")
    key = lambda r: tuple((x is not None, x) for x in r)
    assert found.columns == others.columns == df.columns
    assert sorted(map(tuple, found.collect()), key=key) == sorted((r for r in rows if r[0] is not None and r[0] % 3 == 0), key=key)
    assert sorted(map(tuple, others.collect()), key=key) == sorted((r for r in rows if r[0] is None or r[0] % 3), key=key)


def test_rows_without_ids(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "id long, text string")
    ids = common.written(df.select("id").where(F.lit(False)), "ids")
    assert common.of_ids(df, ids, "id").count() == 0 and common.not_of_ids(df, ids, "id").count() == 2
    assert common.of_ids(df.limit(0), common.written(df.select("id"), "ids"), "id").count() == 0


def test_batches_of_long_texts_are_small(spark):
    """300 texts of 100,000 characters: no batch has more than 4 MB and a row, however few rows that is; less is left as it is."""
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = {k: spark.conf.get(k) for k in keys}
    try:
        common.small_batches(spark)
        long = spark.range(300).coalesce(1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
        sizes = [r["n"] for r in long.mapInArrow(lambda parts: (pa.RecordBatch.from_arrays([pa.array([p.nbytes])], ["n"]) for p in parts), "n long").collect()]
        assert sum(sizes) > 30_000_000 and max(sizes) < (4 << 20) + 200_000
        spark.conf.set(keys[1], 1000)
        common.small_batches(spark)
        assert spark.conf.get(keys[1]) == "1000"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
