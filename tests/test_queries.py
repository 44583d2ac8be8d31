"""Every query that SQL can express against DuckDB, the others for rows and a stable schema."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry_module
from tempograph.plans.queries import QUERIES, SQL, supply_graph

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "timestamp": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def arranged(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    kinds = {r[0]: r[1] for r in duck.execute(f"describe {SQL[name]}").fetchall()}
    assert {c: TYPES.get(t, t) for c, t in found.dtypes} == kinds
    a, b = arranged(found.toPandas()), arranged(duck.execute(SQL[name]).df())
    assert len(a) == len(b)
    for c in a:
        if a[c].dtype == float:
            np.testing.assert_allclose(a[c], b[c], atol=2e-6)
        else:
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist(), c


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_have_rows(spark, name):
    found = QUERIES[name](spark, DATA)
    assert found.count() > 0
    assert all(t != "void" for _, t in found.dtypes)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_cuts_are_of_the_whole_cosupply_graph(spark):
    assert QUERIES["cut_laplacian"](spark, DATA).count() == supply_graph(spark, DATA).rows.count()
