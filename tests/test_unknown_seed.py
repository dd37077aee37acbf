"""Queries about an entity over tables that don't have it: those of the test data without every statement of it."""

import os

import duckdb
import pytest

from skein import queries as core
from skein.operators import graph as G
from skein.plans import retrieval as R
from tests.conftest import tuples
from tests.test_entry import DATA, needs_data

pytestmark = needs_data


@pytest.fixture(scope="module")
def without(tmp_path_factory):
    d = str(tmp_path_factory.mktemp("without"))
    kept = {"triplets": f"subject NOT ILIKE '%{core.SEED}%' AND object NOT ILIKE '%{core.SEED}%'", "entities": f"name <> '{core.SEED}'", "paper_records": "true"}
    for t, where in kept.items():
        duckdb.execute(f"COPY (SELECT * FROM read_parquet('{DATA}/{t}.parquet') WHERE {where}) TO '{d}/{t}.parquet' (FORMAT parquet)")
    return d


def by_sql(name, d):
    con = duckdb.connect()
    for f in os.listdir(d):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{d}/{f}')")
    rel = con.sql(core.SQL[name])
    return sorted(map(repr, rel.fetchall())), rel.columns


def test_bridge_steps(spark, without):
    want, columns = by_sql("bridge_steps", without)
    df = core.QUERIES["bridge_steps"](spark, without)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want == []


def test_pagerank_fixed(spark, without):
    want, columns = by_sql("pagerank_fixed", without)
    df = core.QUERIES["pagerank_fixed"](spark, without)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert got == want and len(got) > 100


def test_search_papers(spark, without):
    df = core.QUERIES["search_papers"](spark, without)
    assert df.columns == ["paper_id", "n", "year", "via", "snippet_html"] and df.count() == 0


def test_chat_facts(spark, without):
    met = core.snapshot(spark, without)
    want = R.facts(met, [core.OTHER])
    df = core.QUERIES["chat_facts"](spark, without)
    assert tuples(df) == tuples(want) and df.count() > 0
    assert R.facts(met, [core.SEED]).count() == 0 and R.facts(met, []).count() == 0


def test_search_nodes(spark, without):
    df = core.QUERIES["search_nodes"](spark, without)
    assert df.columns == ["name", "type", "hop", "parent", "degree"] and df.count() == 0


def test_subgraph(spark, without):
    df = core.QUERIES["subgraph"](spark, without)
    assert df.columns == ["name", "hop", "parent", "ppr"] and df.count() == 0
    adj = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, w double")
    nodes = spark.createDataFrame([("a",), ("b",), ("alone",)], "name string")
    assert tuples(G.local_subgraph(adj, nodes, "alone", steps=2)) == [("alone", 0, None, 1.0)]
    assert [r[:3] for r in tuples(G.local_subgraph(adj, nodes, "a", steps=2))] == [("a", 0, None), ("b", 1, "a")]
