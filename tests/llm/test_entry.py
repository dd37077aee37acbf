import os

import pytest

from skein.llm import queries as Q

DATA = os.environ.get("SKEIN_TEST_DATA", "/root/testdata/sf0.001")
COLUMNS = {
    "p2_found": ["item", "item_id"], "p3_found": ["rec_id"], "p4_found": ["name_a", "name_b"], "p5_found": ["first_rec", "doi", "pmcid", "abstract_rec", "source"],
    "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "from_char", "to_char"],
}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, name):
    if name.startswith("p6") and not os.path.isdir(Q.TOKENIZERS):
        pytest.skip("no tokenizer files")
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    df = Q.QUERIES[name](spark, DATA)
    got = df.collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == held
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(set(got)) == len(got)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    df = Q.QUERIES[name](spark, DATA)
    rel = con.sql(Q.SQL[name])
    at = [rel.columns.index(c) for c in sorted(df.columns)]
    assert sorted(rel.columns) == sorted(df.columns)
    assert sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())
