import os

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
GRAPH = {k for k in entry.queries() if not k.startswith("op") and k != "pipeline"}


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in os.listdir(D):
        c.sql(f"create view {t.split('.')[0]} as select * from '{D}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(GRAPH & set(entry.oracle_sql())))
def test_rows_equal_sql(spark, sql, name):
    a, b = entry.queries()[name](spark, D).toPandas(), sql.sql(entry.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda x: sorted((tuple(None if v != v else v for v in r) for r in x[sorted(a.columns)].astype(object).values.tolist()), key=str)
    assert rows(a) == rows(b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
