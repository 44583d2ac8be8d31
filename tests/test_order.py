from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tempograph.operators.order import dense_index, ranged, running


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(0, 9)), max_size=60))
def test_running_totals(spark, rows):
    rows = [(float(k), n, v) for n, (k, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "k double, n long, v long")
    found = running(ranged(df, "k", 5), ["k", "n"], {"total": F.col("v"), "rank": F.lit(1)}).collect()
    total = 0
    expected = {}
    for place, (k, n, v) in enumerate(sorted(rows), 1):
        total += v
        expected[n] = (total, place)
    assert {r["n"]: (r["total"], r["rank"]) for r in found} == expected


def test_dense_index_drops_nulls_and_repeats(spark):
    df = spark.createDataFrame([(5,), (None,), (3,), (5,), (-1,)], "k long")
    assert sorted(map(tuple, dense_index(df, "k", "n").collect())) == [(-1, 0), (3, 1), (5, 2)]
