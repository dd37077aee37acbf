import math
import random

import pytest
from pyspark.sql import functions as F

from skein.operators import entities as E
from skein.operators import graph as G
from skein.operators import vectors as X
from skein.plans import ingest as I
from skein.plans import retrieval as R
from tests.conftest import tuples

# The statements of the small example graph.
STATEMENTS = [
    ("chocolate", "CONTAINS_COMPOUND", "cocoa", 0.95, "p1", 2016),
    ("cocoa", "CONTAINS_COMPOUND", "flavan-3-ol", 0.9, "p1", 2016),
    ("flavan-3-ol", "INHIBITS", "nf-kb", 0.85, "p2", 2018),
    ("nf-kb", "ACTIVATES", "microglial activation", 0.88, "p3", 2019),
    ("microglial activation", "PROMOTES", "neuroinflammation", 0.9, "p3", 2019),
    ("neuroinflammation", "CONTRIBUTES_TO", "alzheimer's disease", 0.9, "p4", 2020),
    ("curcumin", "INHIBITS", "nf-kb", 0.9, "p5", 2017),
    ("trem2", "REGULATES", "microglial activation", 0.86, "p6", 2021),
]
ROWS = "subject string, relation string, object string, confidence double, paper_id string, year int, seq long, subject_type string, object_type string, subject_raw string, object_raw string, provenance_snippet string"


@pytest.fixture(scope="module")
def rows(spark):
    data = [(s, r, o, c, p, y, i, "Other", "Other", s, o, f"{s} {r} {o}.") for i, (s, r, o, c, p, y) in enumerate(STATEMENTS)]
    return G.insert_rows(spark.createDataFrame(data, ROWS))


@pytest.fixture(scope="module")
def snap(spark, rows):
    papers = spark.createDataFrame([(f"p{i}", f"Paper p{i}", 2015 + i, f"10.0000/p{i}", f"abstract of p{i} mentioning cocoa and nf-kb") for i in range(1, 7)], "paper_id string, title string, year int, doi string, abstract string")
    return R.Snapshot.build(rows, papers)


def test_degrees(snap):
    got = {r["name"]: r["degree"] for r in G.degrees(snap.adj).collect()}
    assert got["nf-kb"] == got["microglial activation"] == 3
    assert got["cocoa"] == got["flavan-3-ol"] == got["neuroinflammation"] == 2
    assert sorted(got.values()) == [1, 1, 1, 1, 2, 2, 2, 3, 3]


def test_pagerank_values(snap):
    p = {r["name"]: r["ppr"] for r in G.pagerank(snap.adj, snap.entities.select("name"), {"chocolate": 1.0}, tol=1e-4).collect()}
    want = {"cocoa": 0.3132, "chocolate": 0.286708, "flavan-3-ol": 0.158984, "nf-kb": 0.10728, "microglial activation": 0.053357, "curcumin": 0.031205}
    assert abs(sum(p.values()) - 1) < 1e-9
    assert all(abs(p[k] - v) < 2e-4 for k, v in want.items())
    with pytest.raises(KeyError):
        G.pagerank(snap.adj, snap.entities.select("name"), {"unknown": 1.0})


def test_dangling_mass_returns(spark, snap):
    nodes = snap.entities.select("name").union(spark.createDataFrame([("alone",)], "name string"))
    p = {r["name"]: r["ppr"] for r in G.pagerank(snap.adj, nodes, {"alone": 1.0}, steps=3).collect()}
    assert abs(p["alone"] - 1) < 1e-12


def test_subgraph(snap):
    sub = G.local_subgraph(snap.adj, snap.entities.select("name"), "chocolate", 20, 3, steps=30)
    assert {r["name"]: r["hop"] for r in sub.collect()} == {"chocolate": 0, "cocoa": 1, "flavan-3-ol": 2, "nf-kb": 3}
    chains = {r["name"]: r["chain"] for r in R.path_to_seed(sub).collect()}
    assert chains["nf-kb"] == ["chocolate", "cocoa", "flavan-3-ol", "nf-kb"]


def test_shortest_path(snap):
    assert G.shortest_paths(snap.edges, "chocolate", "alzheimer's disease", max_hops=5).count() == 0
    r = G.shortest_paths(snap.edges, "chocolate", "alzheimer's disease", max_hops=7).first()
    assert (r["hops"], r["cost"], r["score"]) == (6, 0.9577, 0.518)
    assert G.shortest_paths(snap.edges, "cocoa", "cocoa").count() == 0


def test_shortest_paths_against_enumeration(spark):
    rng = random.Random(5)
    names = [f"n{i}" for i in range(9)]
    data = [(a, f"T{rng.randint(0, 1)}", b, round(rng.uniform(0.3, 0.99), 3), rng.randint(1, 4)) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.5]
    edges = G.graph_edges(spark.createDataFrame(data, "source string, type string, target string, confidence double, support int"))
    cost = {}
    for a, _, b, c, s in data:
        x = -math.log(1 - (1 - c) / (1 + math.log(s))) + 0.05
        cost[a, b] = cost[b, a] = x
    found = []

    def walk(path, total):
        if path[-1] == "n8":
            found.append((total, path))
        elif len(path) <= 4:
            for m in names:
                if m not in path and (path[-1], m) in cost:
                    walk([*path, m], total + cost[path[-1], m])

    walk(["n0"], 0.0)
    want = [p for _, p in sorted(found)[:3]]
    assert [r["nodes"] for r in G.shortest_paths(edges, "n0", "n8", 3, 4).orderBy("rank").collect()] == want


def test_adamic_adar(spark, snap):
    seed = spark.createDataFrame([("curcumin",), ("chocolate",), ("trem2",)], "name string")
    got = {(r["source"], r["target"]): round(r["score"], 4) for r in G.adamic_adar(snap.adj, seed).collect()}
    assert got == {("curcumin", "flavan-3-ol"): 0.5139, ("curcumin", "microglial activation"): 0.5139, ("chocolate", "flavan-3-ol"): 0.5976, ("trem2", "neuroinflammation"): 0.5139, ("trem2", "nf-kb"): 0.5139}


def test_once_per_paper_and_first_year(spark):
    data = [("a", "R", "b", 0.2, "p1", 2010, 1), ("a", "R", "b", 0.9, "p1", 2001, 2), ("a", "R", "b", 0.6, "p2", None, 3), ("a", "R", "b", 0.6, "p2", None, 3)]
    df = spark.createDataFrame([(*r, None, None, None, None, None) for r in data], ROWS)
    r = G.relations(G.relation_papers(G.insert_rows(df)), listed=True).first()
    assert (r["support"], r["papers"], r["first_year"], round(r["confidence"], 6)) == (2, ["p1", "p2"], 2001, 0.4)


def test_insert_rules(spark):
    data = [(" a ", "R", "b", 7.0), ("a", "R", "a", 0.5), ("", "R", "b", 0.5), ("a", " ", "b", 0.5), (None, "R", "b", 0.5), ("a", "NEW", "b", None)]
    df = spark.createDataFrame([(*r, "p", None, i, "", None, None, None, None) for i, r in enumerate(data)], ROWS)
    assert tuples(G.insert_rows(df), "subject", "relation", "confidence", "subject_type") == [("a", "NEW", 0.5, "Other"), ("a", "R", 1.0, "Other")]


def test_zero_confidence_counts_half(spark):
    df = spark.createDataFrame([("a", "R", "b", 0.0, 0)], "source string, type string, target string, confidence double, support int")
    r = G.graph_edges(df).first()
    assert (r["confidence"], r["support"]) == (0.5, 1)


def test_types_and_aliases(spark):
    data = [("a", "R", "b", 0.5, "p", None, 1, "Other", "Gene", "A1", "b", None), ("a", "R", "c", 0.5, "p", None, 2, "Food", "Other", "A2", "c", None), ("a", "R", "c", 0.5, "p", None, 3, "Gene", "Other", "A1", "c", None)]
    got = {r["name"]: (r["type"], r["aliases"]) for r in G.entity_rows(spark.createDataFrame(data, ROWS)).collect()}
    assert got == {"a": ("Food", ["A1", "A2"]), "b": ("Gene", []), "c": ("Other", [])}


def test_evidence_is_of_the_edge(spark, snap):
    got = X.evidence_of(snap.support, snap.evidence).where("source = 'curcumin'").collect()
    assert [(r["type"], r["paper_id"]) for r in got] == [("INHIBITS", "p5")]
    weak = spark.createDataFrame([(f"i{k}", "a", "b", "R", "p", c) for k, c in enumerate([0.1] * 8 + [0.99])], "id string, subject string, object string, relation string, paper_id string, confidence double")
    assert [r["confidence"] for r in X.edge_evidence(weak, 1, source="b", target="a").collect()] == [0.99]
    assert X.edge_evidence(weak, 5, papers=["other"]).count() == 0 and X.edge_evidence(weak, 50, papers=[]).count() == 9


def test_papers_order_null_year_first(spark):
    men = spark.createDataFrame([("x", "p1"), ("x", "p2"), ("y", "p2"), ("x", "p3")], "entity string, paper_id string")
    papers = spark.createDataFrame([("p1", 2000), ("p2", 1990), ("p3", None)], "paper_id string, year int")
    got = G.papers_for_entities(men, papers, spark.createDataFrame([("x",), ("y",)], "name string"))
    assert [r["paper_id"] for r in got.collect()] == ["p2", "p3", "p1"]


def test_search_and_bridge(snap):
    found = R.search(snap, "chocolate")
    assert found["found"] and {"cocoa", "flavan-3-ol", "nf-kb"} <= {r["name"] for r in found["nodes"].collect()}
    assert any("<mark" in r["snippet_html"] for r in found["papers"].collect())
    assert not R.search(snap, "zzz")["found"]
    b = R.bridge(snap, "chocolate", "nf-kb", hops=5)
    assert b["found"] and b["evidence"].count() == 3
    assert R.bridge(snap, "chocolate", "zzz") == {"found": False, "missing": ["zzz"]}
    same = R.bridge(snap, "cocoa", "cocoa")
    assert not same["found"] and same["hypothesis_only"]


def test_context(snap):
    facts = R.facts(snap, ["chocolate", "nf-kb"])
    none = facts.sparkSession.createDataFrame([], "doi string, title string, year int, text string, source string, target string, score double, method string")
    text = R.format_context(facts, none, none)
    assert "E1. chocolate | CONTAINS_COMPOUND | cocoa (certainty 0.95, papers: 1)" in text and text.endswith("none")
    assert R.answer("q", text, True)["answer"].endswith(text) and not R.answer("q", "", False)["grounded"]


def test_question_context(snap):
    spark = snap.adj.sparkSession
    found = R.build_context(snap, "Does curcumin or chocolate act on nf-kb?", focus=["chocolate", "zzz"])
    assert found["entities"] == ["chocolate", "curcumin", "nf-kb"] and found["grounded"] and "chocolate | CONTAINS_COMPOUND | cocoa" in found["context"]
    store = spark.createDataFrame([(f"i{k}", f"text {k}", "p1", [float(k), 1.0]) for k in range(3)], "id string, text string, paper_id string, embedding array<double>")
    found = R.build_context(snap, "nf-kb", embed=lambda q: [2.0, 1.0], chunks=store.where("id = 'i0'"), evidence=store)
    assert [r["id"] for r in found["excerpts"].collect()][0] == "i2" and "P1. " in found["context"]
    nothing = R.build_context(snap, "unheard of")
    assert not nothing["grounded"] and nothing["entities"] == [] and nothing["facts"].count() == 0


def test_predicted_ends_and_scored_pairs(snap):
    shown = {r["name"]: (r["hop"], r["degree"]) for r in R.search(snap, "chocolate", top_k=3, hops=1)["nodes"].collect()}
    assert shown["chocolate"][0] == 0 and all(d > 0 for _, d in shown.values())
    scores = lambda a, b: [r["score"] for r in R.bridge(snap, a, b)["predicted"].collect()]
    assert scores("chocolate", "cocoa") == [0.0] and len(scores("chocolate", "curcumin")) == 1


def test_dense_graphs_and_exact_shares(spark):
    nodes = [f"n{i}" for i in range(12)]
    every = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :]]
    free = set(every[::5])
    pairs = spark.createDataFrame([p for p in every if p not in free], "u string, v string")
    for count in (1, 3, 10, 100):
        got = {tuple(sorted(r)) for r in G.negative_pairs(pairs, count).collect()}
        assert len(got) == min(count, len(free)) and got <= {tuple(sorted(p)) for p in free}
    parts = [r["part"] for r in G.random_split(spark.createDataFrame(every, "u string, v string"), 0.1, 0.2).collect()]
    assert (parts.count("test"), parts.count("val"), parts.count("train")) == (13, 6, 47)
    assert G.random_split(pairs.limit(0)).count() == 0


def test_shortest_paths_against_enumeration(spark):
    import itertools

    rng = random.Random(4)
    names = [f"n{i}" for i in range(9)]
    data = [(a, "R", b, round(rng.uniform(0.2, 0.95), 3), rng.randint(1, 5)) for a, b in itertools.combinations(names, 2) if rng.random() < 0.5]
    edges = G.graph_edges(spark.createDataFrame(data, "source string, type string, target string, confidence double, support int"))
    cost = {frozenset((r["u"], r["v"])): r["cost"] for r in edges.collect()}
    ways = []
    for n in range(0, 4):
        for mid in itertools.permutations(names[1:-1], n):
            path = [names[0], *mid, names[-1]]
            steps = [frozenset(p) for p in zip(path, path[1:])]
            if all(s in cost for s in steps):
                ways.append((sum(cost[s] for s in steps), path))
    want = [p for _, p in sorted(ways)[:6]]
    assert [r["nodes"] for r in G.shortest_paths(edges, names[0], names[-1], k=6, max_hops=4).orderBy("rank").collect()] == want


def test_blocks_of_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(60)] + [(90, [0.0] * 6), (91, None)]
    store = spark.createDataFrame(rows, "id long, embedding array<double>")
    queries = store.where("id % 7 = 0").select(F.col("id").alias("query"), F.col("embedding").alias("vec"))
    top = lambda block: tuples(X.nearest_in_blocks(store.select(F.col("id").alias("key"), F.col("embedding").alias("vec")), queries, 4, block).select("query", "key"))
    unit = {i: [x / sum(y * y for y in v) ** 0.5 for x in v] for i, v in rows if v and any(v)}
    want = sorted((q, i) for q in unit if q % 7 == 0 for i in sorted(unit, key=lambda i: (-sum(a * b for a, b in zip(unit[q], unit[i])), i))[:4])
    assert top(50_000) == want and top(3) == want


def test_both_ways_of_linking_agree(spark):
    aliases = spark.createDataFrame([("cocoa", "cocoa"), ("cocoa", "zz"), ("cocoa butter", "fat"), ("x", "y"), ("nf-kb", "nf-kb")], "alias string, name string")
    docs = spark.createDataFrame([(1, "Cocoa butter, nf-kb"), (1, "cocoa and cocoa"), (1, "cocoa and cocoa"), (None, "cocoa butter"), (3, ""), (4, None)], "k int, t string")
    rows = lambda n: sorted(map(repr, E.link_in_text(docs, aliases, "k", "t", max_aliases=n).collect()))
    assert rows(1) == rows(100) and len(rows(1)) == 5


def test_split_and_negatives(spark):
    pairs = spark.createDataFrame([("a", "b", 2000), ("b", "c", 2001), ("a", "c", 2010), ("a", "z", 2011), ("c", "d", None)], "u string, v string, year int")
    assert tuples(G.temporal_split(pairs, 2005), "u", "v", "part") == [("a", "b", "old"), ("a", "c", "test"), ("b", "c", "old"), ("c", "d", "old")]
    wide = spark.range(200).select(F.concat(F.lit("n"), "id").alias("u"), F.concat(F.lit("n"), F.col("id") + 1).alias("v"))
    neg = G.negative_pairs(wide, 50)
    assert neg.count() == 50 and neg.join(wide, ["u", "v"]).count() == 0 and neg.where("u >= v").count() == 0


def test_metrics(spark):
    data = [(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.2, 0)]
    r = G.auc_ap(spark.createDataFrame(data, "score double, label int")).first()
    assert round(r["auc"], 6) == 0.75 and round(r["ap"], 6) == round((1 + 2 / 4) / 2, 6)


ENTITIES = [("nf-kb", "Protein", ["NF-kappaB"]), ("interleukin-8", "Protein", []), ("cocoa", "Food", ["cacao"])]


def test_resolution(spark):
    entities = spark.createDataFrame(ENTITIES, "name string, type string, aliases array<string>")
    forms = spark.createDataFrame([(f,) for f in ["NF-κB", "nf kb", "Cacao", "the cocoa", "tnf", "IL-6", "new thing", "...", None]], "form string")
    got = {r["form"]: (r["name"], r["how"]) for r in E.resolve(forms, entities).collect()}
    assert got == {"NF-κB": ("nf-kb", "exact"), "nf kb": ("nf-kb", "exact"), "Cacao": ("cocoa", "exact"), "the cocoa": ("cocoa", "exact"), "tnf": ("tumor necrosis factor alpha", "exact"), "IL-6": ("interleukin-6", "exact"), "new thing": ("new thing", "new")}


def test_similarity_stage(spark):
    entities = spark.createDataFrame([("microglial activation", "Process", []), ("interleukin-8", "Protein", [])], "name string, type string, aliases array<string>")
    forms = spark.createDataFrame([("microglial activations",), ("interleukin-9",), ("microglial activation receptor",)], "form string")
    got = {r["form"]: r["name"] for r in E.resolve(forms, entities, E.hash_embedder()).collect()}
    assert got == {"microglial activations": "microglial activation", "interleukin-9": "interleukin-9", "microglial activation receptor": "microglial activation receptor"}
    exact = E.resolve_in_order(["NF-κB", "nf-kb", "microglial activation", "microglial activations"], [("nf-kb", ["NF-kappaB"])], E.hash_embedder())
    assert [n for n, _ in exact] == ["nf-kb", "nf-kb", "microglial activation", "microglial activation"]


def test_text_linking(spark):
    aliases = spark.createDataFrame([("cocoa", "cocoa"), ("cocoa butter", "fat"), ("nf-kb", "nf-kb"), ("ab", "short")], "alias string, name string")
    docs = spark.createDataFrame([(1, "Cocoa butter and cocoa, NF-kB; ab cocoa"), (2, None)], "k int, t string")
    want = [(1, 0, "fat"), (1, 1, "cocoa"), (1, 2, "nf-kb")]
    assert tuples(E.link_in_text(docs, aliases, "k", "t")) == want
    assert tuples(E.link_in_text(docs, aliases, "k", "t", max_aliases=1)) == want


PAPER = "Curcumin strongly inhibits nf-kb in microglial cells of aged mice under stress. " * 4


def _papers(spark, text):
    return spark.createDataFrame([("p1", "T", "", text, 2020)], "paper_id string, title string, abstract string, full_text string, year int")


def test_ingest(spark):
    answer = '{"triplets": [{"subject": "NF-κB", "relation": "inhibits", "object": "curcumin", "confidence": 0.9, "provenance_snippet": "x"}, {"subject": "results", "relation": "r", "object": "b"}, {"subject": "nf-kb", "relation": "INHIBITS", "object": "Curcumin", "confidence": "0.8"}]}'
    entities = spark.createDataFrame([("curcumin", "Chemical", [])], "name string, type string, aliases array<string>")
    run = I.ingest(_papers(spark, PAPER), entities, lambda t, title: answer)
    assert tuples(run["rows"], "subject", "relation", "object") == [("nuclear factor kappa b", "INHIBITS", "curcumin")] * run["rows"].count()
    assert tuples(I.summary(run["status"]), "status", "papers") == [("ok", 1)]
    done = spark.createDataFrame([("p1",)], "paper_id string")
    assert tuples(I.ingest(_papers(spark, PAPER), entities, lambda t, x: answer, done)["status"], "status") == [("skipped",)]
    assert tuples(I.ingest(_papers(spark, PAPER), entities, lambda t, x: answer, done, force=True)["status"], "status") == [("ok",)]
    assert tuples(I.ingest(_papers(spark, PAPER), entities, None)["status"], "status") == [("llm_unavailable",)]
    assert tuples(I.ingest(_papers(spark, "short"), entities, None)["status"], "status") == [("no_text",)]
    assert tuples(I.ingest(_papers(spark, PAPER), entities, lambda t, x: "no json")["status"], "n_triplets") == [(0,)]
