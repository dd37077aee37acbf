import random

from pyspark.sql import functions as F

from skein import schemas
from skein.__main__ import main
from skein.operators import entities as E
from skein.operators import graph as G
from skein.operators import linkmodel as L
from skein.settings import Settings
from tests.conftest import tuples


def test_tables(spark, tmp_path):
    root = str(tmp_path)
    schemas.ensure(spark, root)
    assert schemas.load(spark, root, "papers").count() == 0
    schemas.store(schemas.statement(spark, " Cocoa ", "contains compound", "Flavan-3-ol", 0.95, "p1"), root, "triplets")
    schemas.ensure(spark, root)
    assert tuples(schemas.load(spark, root, "triplets"), "subject", "relation", "object") == [("cocoa", "CONTAINS_COMPOUND", "flavan-3-ol")]
    schemas.clear(spark, root, "triplets")
    assert schemas.load(spark, root, "triplets").count() == 0


def test_link_model(spark, tmp_path):
    rng = random.Random(1)
    names = [f"{g}{i}" for g in "ab" for i in range(20)]
    pairs = [(x, y) for i, x in enumerate(names) for y in names[i + 1 :] if rng.random() < (0.5 if x[0] == y[0] else 0.02)]
    held, kept = pairs[::6], [p for i, p in enumerate(pairs) if i % 6]
    edges = spark.createDataFrame(kept, "u string, v string")
    adj = G.adjacency(edges.withColumn("strength", F.lit(1.0)))
    nodes = E.with_vectors(spark.createDataFrame([(n, "Gene" if n[0] == "a" else "Food") for n in names], "name string, type string"), "name", E.hash_embedder(16))
    x = L.node_features(nodes, adj)
    every = spark.createDataFrame(pairs, "u string, v string")
    model = L.train(edges, G.negative_pairs(every, len(kept)), x)
    test = spark.createDataFrame(held, "u string, v string").withColumn("label", F.lit(1)).unionByName(G.negative_pairs(every, 60, seed=9).withColumn("label", F.lit(0)))
    auc = G.auc_ap(L.score(model, test, x)).first()["auc"]
    assert auc > 0.7
    L.save(model, str(tmp_path / "m"), "hash16", {"auc": auc})
    again = L.load(str(tmp_path / "m"), "hash16")
    assert [round(r["score"], 9) for r in L.score(again, test, x).orderBy("u", "v").collect()] == [round(r["score"], 9) for r in L.score(model, test, x).orderBy("u", "v").collect()]
    assert L.load(str(tmp_path / "m"), "other") is None and L.load(str(tmp_path / "none"), "x") is None


def test_settings_and_command(capsys):
    assert Settings(scrape_queries=" a; ;b").queries() == ["a", "b"]
    assert main([]) == 0 and "relation_edges" in capsys.readouterr().out and main(["unknown"]) == 2
