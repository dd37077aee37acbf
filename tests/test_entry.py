import os

import duckdb
import pytest

import __spark_entry__ as entry
from skein import queries as core

DATA = os.environ.get("SKEIN_TEST_DATA", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@needs_data
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0


@needs_data
@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    df = core.QUERIES[name](spark, DATA)
    order = sorted(df.columns)
    rel = con.sql(core.SQL[name])
    assert sorted(rel.columns) == order
    at = [rel.columns.index(c) for c in order]
    want = sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())
    assert sorted(repr(tuple(r[c] for c in order)) for r in df.collect()) == want
