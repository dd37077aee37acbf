"""Queries of the core package: one per operator, each over whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import oracle as O
from skein.functions import scalars as S
from skein.functions import text as T
from skein.operators import entities as E
from skein.operators import extraction as X
from skein.operators import graph as G
from skein.operators import vectors as VX
from skein.operators.packed import unpack_rows
from skein.plans import ingest as I
from skein.plans import retrieval as R
from skein.session import cut, table
from skein.streaming import flows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: The entity that the queries about one entity ask for, and another one to reach from it.
SEED, OTHER = "fuvuguate", "dairy goats"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Shared views ---------------------------------------------------------------------------------------------------


def names(spark: SparkSession, sf: str) -> DataFrame:
    """Surface forms of the triplets with their entities."""
    forms = table(spark, sf, "triplets").select(F.explode(F.array("subject", "object")).alias("form"))
    return cut(E.resolve(forms, table(spark, sf, "entities")))


def rows(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical triplets, as they are inserted."""
    triplets = table(spark, sf, "triplets").withColumns({"relation": S.normalize_relation(F.col("relation")), "subject_type": S.normalize_type(F.col("subject_type")), "object_type": S.normalize_type(F.col("object_type")), "year": S.clean_year(F.col("year"))})
    return G.insert_rows(E.canonical_triplets(triplets, names(spark, sf)))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges with measures."""
    return G.graph_edges(G.relations(G.relation_papers(rows(spark, sf))))


def adjacency(spark: SparkSession, sf: str) -> DataFrame:
    """Undirected strengths."""
    return G.adjacency(edges(spark, sf))


def papers(spark: SparkSession, sf: str) -> DataFrame:
    """Papers after all fetched records were upserted in order of arrival."""
    return G.upsert_papers(table(spark, sf, "paper_records"), ["landed_at", "rec_id"])


def snapshot(spark: SparkSession, sf: str) -> R.Snapshot:
    """The tables of the composite queries."""
    return R.Snapshot.build(cut(rows(spark, sf)), cut(papers(spark, sf)), table(spark, sf, "entities"))


# Problem 1 ------------------------------------------------------------------------------------------------------


@query()
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every name of every author list with its place in the list."""
    records = table(spark, sf, "paper_records").select("rec_id", "authors")
    return unpack_rows(records, "authors", value="author").select("rec_id", "pos", "author")


# Writing the graph ----------------------------------------------------------------------------------------------


@query(O.ROWS + "SELECT subject, relation, object, paper_id, seq, round(confidence, 6) AS confidence, subject_type, object_type, subject_raw, object_raw FROM rows_")
def canonical_triplets(spark: SparkSession, sf: str) -> DataFrame:
    """Triplets with canonical entities and relations."""
    return rows(spark, sf).select("subject", "relation", "object", "paper_id", "seq", F.round("confidence", 6).alias("confidence"), "subject_type", "object_type", "subject_raw", "object_raw")


@query("SELECT trim(subject) AS subject, trim(relation) AS relation, trim(object) AS object, paper_id, seq, least(greatest(coalesce(confidence, 0.5), 0), 1) AS confidence, coalesce(nullif(subject_type, ''), 'Other') AS subject_type, coalesce(nullif(object_type, ''), 'Other') AS object_type FROM triplets WHERE trim(coalesce(subject, '')) <> '' AND trim(coalesce(object, '')) <> '' AND trim(coalesce(relation, '')) <> '' AND trim(subject) <> trim(object)")
def inserted_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Triplets as an insert keeps them."""
    return G.insert_rows(table(spark, sf, "triplets")).select("subject", "relation", "object", "paper_id", "seq", "confidence", "subject_type", "object_type")


_REL = "SELECT source, type, target, support, round(conf_sum, 6) AS conf_sum, round(confidence, 6) AS confidence, first_year, array_to_string(papers, '|') AS papers FROM rel"


def _relations(found: DataFrame) -> DataFrame:
    return found.select("source", "type", "target", "support", F.round("conf_sum", 6).alias("conf_sum"), F.round("confidence", 6).alias("confidence"), "first_year", F.array_join("papers", "|").alias("papers"))


@query(O.ROWS + _REL)
def relation_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges with evidence aggregated over papers."""
    return _relations(G.relations(G.relation_papers(rows(spark, sf)), listed=True))


@query(O.ROWS + _REL)
def relation_edges_merged(spark: SparkSession, sf: str) -> DataFrame:
    """The same edges, built from two batches by merging."""
    every = cut(rows(spark, sf))
    middle = every.agg(F.expr("percentile_approx(seq, 0.5)").alias("m"))
    old = every.crossJoin(F.broadcast(middle)).where("seq <= m").drop("m")
    new = every.crossJoin(F.broadcast(middle)).where("seq > m").drop("m")
    return _relations(G.relations(G.merge_relation_papers(G.relation_papers(old), G.relation_papers(new)), listed=True))


@query(O.ROWS + """, met AS (SELECT subject AS name, subject_type AS type, subject_raw AS raw, seq * 2 AS pos FROM rows_ UNION ALL SELECT object, object_type, object_raw, seq * 2 + 1 FROM rows_),
forms2 AS (SELECT name, raw, min(pos) AS pos FROM met GROUP BY 1, 2)
SELECT m.name, coalesce(t.type, 'Other') AS type, coalesce(a.aliases, '') AS aliases FROM (SELECT DISTINCT name FROM met) m
LEFT JOIN (SELECT name, arg_min(type, (pos, type)) AS type FROM met WHERE type <> 'Other' GROUP BY 1) t USING (name)
LEFT JOIN (SELECT name, string_agg(raw, '|' ORDER BY pos, raw) AS aliases FROM forms2 WHERE raw <> name GROUP BY 1) a USING (name)""")
def entity_table(spark: SparkSession, sf: str) -> DataFrame:
    """Entities with type and aliases, as the triplets build them."""
    return G.entity_rows(rows(spark, sf)).select("name", "type", F.array_join("aliases", "|").alias("aliases"))


@query(O.ROWS + "SELECT entity, paper_id FROM men")
def entity_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Which paper mentions which entity."""
    return G.mentions(rows(spark, sf))


_FIELDS = ("doi", "pmid", "pmcid", "title", "journal", "abstract", "source", "url", "authors")


@query("SELECT paper_id, " + ", ".join(f"arg_max(nullif({c}, ''), (landed_at, rec_id)) FILTER (nullif({c}, '') IS NOT NULL) AS {c}" for c in _FIELDS) + f", arg_max({O.year('year')}, (landed_at, rec_id)) FILTER ({O.year('year')} IS NOT NULL) AS year FROM paper_records WHERE paper_id IS NOT NULL GROUP BY 1")
def upserted_papers(spark: SparkSession, sf: str) -> DataFrame:
    """Papers after all records were upserted."""
    return papers(spark, sf)


@query("WITH t AS (SELECT paper_id, count(*) AS n FROM triplets GROUP BY 1), p AS (SELECT DISTINCT paper_id FROM paper_records WHERE paper_id IS NOT NULL) SELECT p.paper_id, t.n AS n_triplets, t.n IS NOT NULL AS processed FROM p LEFT JOIN t USING (paper_id)")
def processed_papers(spark: SparkSession, sf: str) -> DataFrame:
    """Papers marked processed when triplets of them are there."""
    runs = table(spark, sf, "triplets").groupBy("paper_id").agg(F.count("*").alias("n_triplets"))
    return G.mark_processed(table(spark, sf, "paper_records").where("paper_id is not null").select("paper_id").distinct(), runs).select("paper_id", "n_triplets", "processed")


@query("WITH t AS (SELECT paper_id, count(*) AS n FROM triplets WHERE paper_id IN (SELECT paper_id FROM paper_records) GROUP BY 1), w AS (SELECT paper_id FROM t ORDER BY n DESC, paper_id LIMIT 20) SELECT paper_id, arg_max(nullif(title, ''), (landed_at, rec_id)) FILTER (nullif(title, '') IS NOT NULL) AS title FROM paper_records WHERE paper_id IN (SELECT paper_id FROM w) GROUP BY 1")
def papers_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """The papers of a list of ids: the twenty with most triplets."""
    met = table(spark, sf, "triplets").join(table(spark, sf, "paper_records").select("paper_id").distinct(), "paper_id", "left_semi")
    ids = [r["paper_id"] for r in met.groupBy("paper_id").count().orderBy(F.desc("count"), "paper_id").limit(20).collect()]
    return G.papers_by_id(papers(spark, sf), ids).select("paper_id", "title")


@query("SELECT DISTINCT paper_id FROM paper_records WHERE paper_id IS NOT NULL AND paper_id NOT IN (SELECT paper_id FROM triplets WHERE paper_id IS NOT NULL)")
def pending_papers(spark: SparkSession, sf: str) -> DataFrame:
    """Papers still to be read."""
    every = table(spark, sf, "paper_records").where("paper_id is not null").select("paper_id").distinct()
    return I.pending(every, table(spark, sf, "triplets").select("paper_id").distinct())


@query("WITH n AS (SELECT paper_id, max(fetched_at) AS latest FROM paper_records WHERE paper_id IS NOT NULL GROUP BY 1) SELECT paper_id FROM n ORDER BY latest DESC, paper_id LIMIT 50 OFFSET 10")
def recent_papers(spark: SparkSession, sf: str) -> DataFrame:
    """A page of the latest papers."""
    latest = table(spark, sf, "paper_records").where("paper_id is not null").groupBy("paper_id").agg(F.max("fetched_at").alias("at"))
    return latest.orderBy(F.desc("at"), "paper_id").offset(10).limit(50).select("paper_id")


# Reading the graph ----------------------------------------------------------------------------------------------


@query(O.ROWS + "SELECT (SELECT count(DISTINCT entity) FROM men) AS entities, (SELECT count(DISTINCT paper_id) FROM paper_records) AS papers, (SELECT count(*) FROM rel) AS relations, (SELECT count(DISTINCT p.paper_id) FROM paper_records p JOIN triplets t USING (paper_id)) AS processed_papers")
def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of entities, papers, relations and processed papers."""
    every = cut(rows(spark, sf))
    records, triplets = table(spark, sf, "paper_records"), table(spark, sf, "triplets")
    one = lambda df, c, n: df.agg(F.count_distinct(c).alias(n))
    done = records.select("paper_id").distinct().join(triplets.select("paper_id").distinct(), "paper_id", "left_semi")
    parts = [one(G.mentions(every), "entity", "entities"), one(records, "paper_id", "papers"), every.select("subject", "relation", "object").distinct().agg(F.count("*").alias("relations")), done.agg(F.count("*").alias("processed_papers"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # four single rows
    return out


@query(O.ROWS + "SELECT src, dst, round(w, 6) AS w FROM adj")
def graph_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    """Undirected strengths, both ways."""
    return adjacency(spark, sf).withColumn("w", F.round("w", 6))


@query(O.ROWS + "SELECT name, degree FROM deg")
def node_degrees(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct neighbours of every node."""
    return G.degrees(adjacency(spark, sf))


@query(O.ROWS + "SELECT u, v, count(*) AS n, array_to_string(list_sort(list(DISTINCT type)), '|') AS types, round(min(cost), 6) AS cost FROM meas GROUP BY 1, 2")
def pair_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Directed edges grouped by pair, with the cheapest cost."""
    return G.pair_groups(edges(spark, sf)).select("u", "v", "n", F.array_join("types", "|").alias("types"), F.round("cost", 6).alias("cost"))


@query(O.ROWS + "SELECT u, v, round(strength, 6) AS strength FROM best")
def best_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Strength of the best edge of every pair."""
    best = G.best_edges(edges(spark, sf))
    return best.select("u", "v", F.round(S.edge_strength(F.col("confidence"), F.col("support")), 6).alias("strength"))


@query(O.ROWS + "SELECT u, v, min(first_year) AS year FROM edge GROUP BY 1, 2")
def pair_years(spark: SparkSession, sf: str) -> DataFrame:
    """First year of every linked pair."""
    return G.pair_years(edges(spark, sf))


@query(O.ROWS + f"SELECT CASE WHEN b.u = '{SEED}' THEN b.v ELSE b.u END AS name, round(b.confidence * b.support, 6) AS rating, d.degree FROM best b JOIN deg d ON d.name = CASE WHEN b.u = '{SEED}' THEN b.v ELSE b.u END WHERE '{SEED}' IN (b.u, b.v)")
def entity_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours of an entity by confidence and support."""
    e = cut(edges(spark, sf))
    return G.neighbors(e, G.adjacency(e), SEED, limit=None).select("name", F.round("rating", 6).alias("rating"), "degree")


@query(O.ROWS + "SELECT source, type, target, support, array_to_string(papers, '|') AS papers FROM edge WHERE (source = 'fuvuguate' AND target = 'rgk17') OR (source = 'rgk17' AND target = 'fuvuguate')")
def edge_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """All edges between two entities."""
    found = G.relations(G.edges_between(G.relation_papers(rows(spark, sf)), SEED, "rgk17"), listed=True)
    return found.select("source", "type", "target", "support", F.array_join("papers", "|").alias("papers"))


@query(O.ROWS + ", p AS (SELECT DISTINCT paper_id FROM paper_records) SELECT e.source, e.type, e.target, x.paper_id, p.paper_id IS NOT NULL AS known FROM (SELECT source, type, target, unnest(papers) AS paper_id FROM edge) x JOIN edge e USING (source, type, target) LEFT JOIN p ON p.paper_id = x.paper_id")
def edge_papers(spark: SparkSession, sf: str) -> DataFrame:
    """Every edge with its papers."""
    known = table(spark, sf, "paper_records").select("paper_id").distinct().withColumn("known", F.lit(True))
    listed = G.relation_papers(rows(spark, sf)).select("source", "type", "target", "paper_id")
    return listed.join(known, "paper_id", "left").select("source", "type", "target", "paper_id", F.coalesce("known", F.lit(False)).alias("known"))


@query(O.ROWS + f"SELECT m.paper_id, count(DISTINCT entity) AS n, string_agg(DISTINCT entity, '|' ORDER BY entity) AS entities FROM men m JOIN (SELECT DISTINCT paper_id FROM paper_records) p USING (paper_id) WHERE entity IN ('{SEED}', '{OTHER}', 'rgk17', 'vuyufoan-2-ol') GROUP BY 1")
def papers_for_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Papers that mention any of four entities."""
    wanted = spark.createDataFrame([(n,) for n in (SEED, OTHER, "rgk17", "vuyufoan-2-ol")], "name string")
    found = G.papers_for_entities(G.mentions(rows(spark, sf)), papers(spark, sf), wanted)
    return found.select("paper_id", F.col("n").cast("bigint").alias("n"), F.array_join("entities", "|").alias("entities"))


@query("WITH t AS (SELECT DISTINCT subject AS term, lower(trim(subject)) AS t FROM triplets), m AS (SELECT term, 0 AS rk, e.name FROM t JOIN entities e ON e.name = t.t UNION ALL SELECT term, 1, e.name FROM t JOIN (SELECT name, unnest(aliases) AS a FROM entities) e ON e.a = t.t) SELECT term, name FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY rk, name) AS r FROM m) WHERE r = 1")
def found_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Every subject looked up by name, then alias."""
    return G.find_entity(table(spark, sf, "entities"), table(spark, sf, "triplets").select(F.col("subject").alias("term")).distinct())


@query("WITH w AS (SELECT name, type, string_split_regex(lower(name || ' ' || array_to_string(aliases, ' ')), '[^a-z0-9α-ω]+') AS ws FROM entities), s AS (SELECT name, type, (list_aggregate([CASE WHEN starts_with(x, 'acu') THEN 1 ELSE 0 END FOR x IN ws], 'max') + list_aggregate([CASE WHEN starts_with(x, 'mar') THEN 1 ELSE 0 END FOR x IN ws], 'max'))::INTEGER AS score FROM w) SELECT name, type, score FROM s WHERE score > 0 ORDER BY score DESC, length(name), name LIMIT 10")
def suggested_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entities whose words begin like the typed ones."""
    return G.search_entities(table(spark, sf, "entities"), "acu mar")


@query("SELECT name, type FROM entities WHERE contains(name, 'ase-') OR len([a FOR a IN aliases IF contains(lower(a), 'ase-')]) > 0")
def contained_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entities whose name or alias contains a text."""
    return G.contains_entities(table(spark, sf, "entities"), "ase-")


@query("SELECT alias, name FROM (SELECT alias, name, row_number() OVER (PARTITION BY alias ORDER BY rk, name) AS r FROM (SELECT lower(name) AS alias, 0 AS rk, name FROM entities UNION ALL SELECT lower(unnest(aliases)), 1, name FROM entities)) WHERE r = 1")
def alias_index(spark: SparkSession, sf: str) -> DataFrame:
    """Lower-case names and aliases."""
    return E.alias_index(table(spark, sf, "entities"))


# Entity resolution ----------------------------------------------------------------------------------------------


@query(f"WITH {O.NAMED} SELECT form, norm, name, how FROM named")
def resolved_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Every surface form with its entity, by keys and synonyms."""
    return names(spark, sf)


@query()
def resolved_similar(spark: SparkSession, sf: str) -> DataFrame:
    """Every surface form with its entity, similarity included."""
    forms = table(spark, sf, "triplets").select(F.explode(F.array("subject", "object")).alias("form"))
    return E.resolve(forms, table(spark, sf, "entities"), E.hash_embedder())


_STEM = "list_distinct([CASE WHEN length(t) > 3 AND t[-1] = 's' THEN t[:-2] ELSE t END FOR t IN regexp_extract_all(lower({0}), '[a-z0-9]+')])"
_PAIRS = "WITH n AS (SELECT DISTINCT name FROM entities), k AS (SELECT name, unnest(" + _STEM.format("name") + ") AS t FROM n), p AS (SELECT DISTINCT a.name AS a, b.name AS b FROM k a JOIN k b ON a.t = b.t AND a.name < b.name)"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of entity names that share a word but for its plural, which is how likely variants meet."""
    n = table(spark, sf, "entities").select("name").distinct().select("name", F.explode(S.stem_tokens(F.col("name"))).alias("t"))
    return n.withColumnRenamed("name", "a").join(n.withColumnRenamed("name", "b"), "t").where("a < b").select("a", "b").distinct()


@query(_PAIRS + " SELECT a, b, round(jaro_winkler_similarity(a, b), 6) AS jw FROM p")
def name_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Jaro-Winkler similarity of entity names that share a word."""
    return _pairs(spark, sf).select("a", "b", F.round(T.jw("a", "b"), 6).alias("jw"))




@query(_PAIRS + f" SELECT a, b, (list_sort(regexp_extract_all(a, '\\d+')) <> list_sort(regexp_extract_all(b, '\\d+')) OR least(length(a), length(b)) < 4 OR len([x FOR x IN {_STEM.format('a')} || {_STEM.format('b')} IF (list_contains({_STEM.format('a')}, x) <> list_contains({_STEM.format('b')}, x)) AND x IN ({O.listed(O.V.MODIFIERS)})]) > 0) AS blocked FROM p")
def merge_guards(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of entity names that must not be merged."""
    return _pairs(spark, sf).select("a", "b", S.merge_blocked(F.col("a"), F.col("b")).alias("blocked"))


@query("WITH d AS (SELECT subject AS s, count(*) AS n FROM triplets GROUP BY 1) SELECT s, array_to_string(list_sort(regexp_extract_all(s, '\\d+')), ',') AS digits, array_to_string(list_sort(" + _STEM.format("s") + "), ',') AS stems FROM d")
def name_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Digit signature and stems of every subject."""
    s = table(spark, sf, "triplets").select(F.col("subject").alias("s")).where("s is not null").distinct()
    return s.select("s", F.array_join(S.digit_signature(F.col("s")), ",").alias("digits"), F.array_join(F.array_sort(S.stem_tokens(F.col("s"))), ",").alias("stems"))


# Link prediction and paths --------------------------------------------------------------------------------------


@query(O.ROWS + f"SELECT source, target, round(score, 6) AS score FROM aa WHERE source = '{SEED}'")
def adamic_adar(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all nodes two steps from an entity."""
    seed = spark.createDataFrame([(SEED,)], "name string")
    return G.adamic_adar(cut(adjacency(spark, sf)), seed).select("source", "target", F.round("score", 6).alias("score"))


@query(O.ROWS + f", ns AS (SELECT name FROM entities WHERE type = 'Food' OR name = '{SEED}') SELECT source, target, round(score, 6) AS score FROM aa WHERE source < target AND source IN (SELECT name FROM ns) AND target IN (SELECT name FROM ns) AND score >= 0.3 ORDER BY round(score, 9) DESC, source, target LIMIT 50")
def missing_links(spark: SparkSession, sf: str) -> DataFrame:
    """Likeliest missing links among the foods and an entity."""
    wanted = table(spark, sf, "entities").where((F.col("type") == "Food") | (F.col("name") == SEED)).select("name")
    return G.missing_links(cut(adjacency(spark, sf)), wanted, 50, 0.3).select("source", "target", F.round("score", 6).alias("score"))


@query(O.ROWS + ", h AS (SELECT name FROM deg ORDER BY degree DESC, name LIMIT 2000), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, target) AS rk FROM aa WHERE source IN (SELECT name FROM h)) SELECT source, target, round(score, 6) AS score, 'adamic_adar' AS method FROM r WHERE rk <= 5 AND score >= 0.8")
def predicted_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of the hubs, as they are materialised."""
    return G.materialize_predictions(cut(adjacency(spark, sf))).withColumn("score", F.round("score", 6))


@query(O.pagerank_sql(SEED, 6))
def pagerank_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """Personalised PageRank after six rounds; 0 for all nodes if the entity is unknown."""
    adj = cut(adjacency(spark, sf))
    nodes = adj.select(F.col("src").alias("name")).union(table(spark, sf, "entities").select("name"))
    return G.pagerank(adj, nodes, {SEED: 1.0}, steps=6, missing_ok=True).select("name", F.round("ppr", 8).alias("ppr"))


@query()
def subgraph(spark: SparkSession, sf: str) -> DataFrame:
    """The connected subgraph of the nodes most relevant to an entity; empty if it is unknown."""
    adj = cut(adjacency(spark, sf))
    nodes = adj.select(F.col("src").alias("name")).distinct()
    return G.local_subgraph(adj, nodes, SEED, steps=20).select("name", "hop", "parent", F.round("ppr", 6).alias("ppr"))


@query(O.ROWS + f"SELECT a.dst AS mid, b.dst AS target FROM adj a JOIN adj b ON a.dst = b.src WHERE a.src = '{SEED}' AND b.dst <> '{SEED}' UNION ALL SELECT dst, NULL FROM adj WHERE src = '{SEED}'")
def two_hop_paths(spark: SparkSession, sf: str) -> DataFrame:
    """All simple paths of one and two steps from an entity."""
    paths = G.k_hop_paths(cut(adjacency(spark, sf)), SEED, 2)
    return paths.select(F.col("nodes")[1].alias("mid"), F.try_element_at("nodes", F.lit(3)).alias("target"))


_PATHS = f""", pc AS (SELECT u, v, min(cost) AS cost FROM meas GROUP BY 1, 2), st AS (SELECT u AS a, v AS b, cost FROM pc UNION ALL SELECT v, u, cost FROM pc),
f1 AS (SELECT b AS n, [a, b] AS p, cost FROM st WHERE a = '{SEED}'), f2 AS (SELECT st.b AS n, list_append(f1.p, st.b) AS p, f1.cost + st.cost AS cost FROM f1 JOIN st ON st.a = f1.n WHERE f1.n <> '{OTHER}'),
g1 AS (SELECT a AS n, [b] AS p, cost FROM st WHERE b = '{OTHER}'), g2 AS (SELECT st.a AS n, list_prepend(st.b, g1.p) AS p, st.cost + g1.cost AS cost FROM g1 JOIN st ON st.b = g1.n WHERE g1.n <> '{SEED}'),
w AS (SELECT p, cost FROM f1 WHERE n = '{OTHER}' UNION ALL SELECT p, cost FROM f2 WHERE n = '{OTHER}' UNION ALL SELECT list_concat(f2.p, g1.p), f2.cost + g1.cost FROM f2 JOIN g1 USING (n) UNION ALL SELECT list_concat(f2.p, g2.p), f2.cost + g2.cost FROM f2 JOIN g2 USING (n)),
top AS (SELECT * FROM (SELECT p, row_number() OVER (ORDER BY cost, p) AS rank FROM w WHERE len(list_distinct(p)) = len(p)) WHERE rank <= 3),
walk AS (SELECT s.rank, s.p, s.i, b.source, b.type, b.target, b.confidence, b.support, {O.cost('b.confidence', 'b.support')} AS c FROM (SELECT rank, p, unnest(range(1, len(p))) AS i FROM top) s JOIN best b ON b.u = least(s.p[s.i], s.p[s.i + 1]) AND b.v = greatest(s.p[s.i], s.p[s.i + 1]))"""


@query(O.ROWS + _PATHS + " SELECT rank::INTEGER AS rank, array_to_string(p, ' > ') AS nodes, count(*)::INTEGER AS hops, round(sum(c), 4) AS cost, round(product(confidence), 4) AS score FROM walk GROUP BY rank, p")
def shortest_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The cheapest paths between two entities."""
    found = G.shortest_paths(cut(edges(spark, sf)), SEED, OTHER, k=3, max_hops=4)
    return found.select("rank", F.array_join("nodes", " > ").alias("nodes"), "hops", "cost", "score")


@query(O.ROWS + ", y AS (SELECT u, v, min(first_year) AS year FROM edge GROUP BY 1, 2), o AS (SELECT * FROM y WHERE coalesce(year <= 2015, true)), k AS (SELECT u AS n FROM o UNION SELECT v FROM o) SELECT u, v, year, 'old' AS part FROM o UNION ALL SELECT u, v, year, 'test' FROM y WHERE year > 2015 AND u IN (SELECT n FROM k) AND v IN (SELECT n FROM k)")
def temporal_split(spark: SparkSession, sf: str) -> DataFrame:
    """Linked pairs before and after a cutoff year."""
    return G.temporal_split(cut(G.pair_years(edges(spark, sf))), 2015)


@query(O.ROWS + ", y AS (SELECT DISTINCT u, v FROM edge), r AS (SELECT u, v, row_number() OVER (ORDER BY md5(u || '|' || v || '|42')) - 1 AS r, count(*) OVER () AS n FROM y) SELECT u, v, CASE WHEN r < floor(n * 0.1 + 1e-9) THEN 'test' WHEN r < floor(n * 0.2 + 1e-9) THEN 'val' ELSE 'train' END AS part FROM r")
def random_split(spark: SparkSession, sf: str) -> DataFrame:
    """Linked pairs parted at random in exact shares."""
    return G.random_split(G.pair_years(edges(spark, sf)).select("u", "v"))


@query()
def negative_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """A thousand pairs of nodes without a link, as a model is trained with."""
    return G.negative_pairs(cut(G.pair_years(edges(spark, sf)).select("u", "v")), 1000)


@query("WITH s AS (SELECT vec_id, embedding[1]::DOUBLE AS s, CASE WHEN label % 2 = 0 THEN 1 ELSE 0 END AS y FROM embeddings), g AS (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY 1), w AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb, sum(p) OVER (ORDER BY s DESC) AS pa, sum(n) OVER (ORDER BY s DESC) AS na FROM g) SELECT round(sum(p * (nb + n / 2)) / (sum(p) * sum(n)), 6) AS auc, round(sum(p * pa / (pa + na)) / sum(p), 6) AS ap FROM w")
def ranking_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Area under the ROC curve and average precision of a score."""
    scored = table(spark, sf, "embeddings").select(F.col("embedding")[0].cast("double").alias("score"), F.when(F.col("label") % 2 == 0, 1).otherwise(0).alias("label"))
    return G.auc_ap(scored).select(F.round("auc", 6).alias("auc"), F.round("ap", 6).alias("ap"))


# Vectors and evidence -------------------------------------------------------------------------------------------


@query("WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q.e::DOUBLE[]), 4) AS score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q.e::DOUBLE[]) DESC, vec_id LIMIT 10")
def nearest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors nearest to one."""
    store = table(spark, sf, "embeddings")
    q = store.where("vec_id = 0").first()["embedding"]
    return VX.nearest(store, q, 10, key="vec_id").select("vec_id", "score")


@query("WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.query, b.vec_id, list_cosine_similarity(b.embedding::DOUBLE[], q.e) AS x FROM q, embeddings b) SELECT query, vec_id, round(x, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY x DESC, vec_id) AS r FROM s) WHERE r <= 5")
def nearest_each(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one, against all."""
    store = table(spark, sf, "embeddings")
    return VX.nearest_each(store.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vec")), store, 5, key="vec_id")


@query("WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q.e::DOUBLE[]), 4) AS score FROM embeddings, q WHERE label IN (1, 2) ORDER BY list_cosine_similarity(embedding::DOUBLE[], q.e::DOUBLE[]) DESC, vec_id LIMIT 10")
def nearest_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest vectors among those with given labels."""
    store = table(spark, sf, "embeddings")
    q = store.where("vec_id = 0").first()["embedding"]
    return VX.nearest(store, q, 10, where=F.col("label").isin(1, 2), key="vec_id").select("vec_id", "score")


_PROV = """, pl AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY seq, subject, relation, object) - 1 AS place FROM (SELECT DISTINCT paper_id, seq, subject, relation, object, confidence, provenance_snippet FROM rows_)),
prov AS (SELECT sha1(coalesce(paper_id, '') || '||' || subject || '||' || relation || '||' || object || '||' || place || '||' || substr(provenance_snippet, 1, 48)) AS id, * FROM pl WHERE trim(coalesce(provenance_snippet, '')) <> '')"""


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    return _evidence_of(cut(rows(spark, sf)))


def _evidence_of(every: DataFrame) -> DataFrame:
    return VX.provenance_rows(every.select("paper_id", "seq", "subject", "relation", "object", "confidence", "provenance_snippet").distinct())


@query(O.ROWS + _PROV + "SELECT id, paper_id, subject, relation, object, round(confidence, 6) AS confidence, provenance_snippet AS text FROM prov")
def provenance_store(spark: SparkSession, sf: str) -> DataFrame:
    """Snippets under stable ids."""
    return _evidence(spark, sf).select("id", "paper_id", "subject", "relation", "object", F.round("confidence", 6).alias("confidence"), "text")


@query(O.ROWS + _PROV + "SELECT 'provenance' AS collection, count(DISTINCT id) AS rows FROM prov UNION ALL SELECT 'mentions', count(*) FROM men")
def store_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the stores."""
    every = cut(rows(spark, sf))
    return VX.counts(provenance=_evidence_of(every), mentions=G.mentions(every))


@query(O.ROWS + _PROV + ", x AS (SELECT source, type, target, u, v, unnest(papers) AS paper_id FROM edge), j AS (SELECT x.source, x.type, x.target, p.id, row_number() OVER (PARTITION BY x.source, x.type, x.target ORDER BY p.confidence DESC NULLS LAST, p.id) AS rank FROM x JOIN prov p ON least(p.subject, p.object) = x.u AND greatest(p.subject, p.object) = x.v AND p.relation = x.type AND p.paper_id = x.paper_id) SELECT source, type, target, id, rank::INTEGER AS rank FROM j WHERE rank <= 2")
def edge_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The two best snippets of every edge from its own papers."""
    every = cut(rows(spark, sf))
    return VX.evidence_of(G.relation_papers(every), _evidence_of(every)).select("source", "type", "target", "id", "rank")


@query(O.ROWS + _PROV + f"SELECT id, round(confidence, 6) AS confidence FROM prov WHERE ((subject = '{SEED}' AND object = 'rgk17') OR (subject = 'rgk17' AND object = '{SEED}')) ORDER BY confidence DESC NULLS LAST, id LIMIT 5")
def pair_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The best snippets of a pair, either way."""
    return VX.edge_evidence(_evidence(spark, sf), 5, source=SEED, target="rgk17").select("id", F.round("confidence", 6).alias("confidence"))


# Extraction -----------------------------------------------------------------------------------------------------


@query(f"WITH t AS (SELECT paper_id, seq, trim(subject) AS s, trim(object) AS o, {O.relation('relation')} AS r, round(least(greatest(coalesce(confidence, 0.6), 0), 1), 3) AS c FROM triplets), k AS (SELECT * FROM t WHERE s <> '' AND o <> '' AND r <> '' AND lower(s) <> lower(o) AND length(s) BETWEEN 2 AND 80 AND length(o) BETWEEN 2 AND 80 AND lower(s) NOT IN ({O.listed(O.V.GENERIC_ENTITIES)}) AND lower(o) NOT IN ({O.listed(O.V.GENERIC_ENTITIES)}) AND regexp_matches(s, '[A-Za-zα-ω]') AND regexp_matches(o, '[A-Za-zα-ω]') AND c >= 0.5) SELECT paper_id, s AS subject, r AS relation, o AS object, c AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, lower(s), r, lower(o) ORDER BY c DESC, seq, s, o) AS n FROM k) WHERE n = 1")
def validated_triplets(spark: SparkSession, sf: str) -> DataFrame:
    """Proposals that hold up, the most confident one per statement of a paper."""
    items = table(spark, sf, "triplets").withColumn("chunk_id", F.col("paper_id")).withColumn("seq", F.struct("seq", F.btrim("subject").alias("s"), F.btrim("object").alias("o")))
    return X.validate(items, text=None).select("paper_id", "subject", "relation", "object", "confidence")


@query(f"SELECT relation AS raw, {O.relation('relation')} AS relation, count(*) AS n FROM triplets GROUP BY 1, 2")
def relation_names(spark: SparkSession, sf: str) -> DataFrame:
    """Relations in the vocabulary's spelling."""
    t = table(spark, sf, "triplets")
    return t.groupBy(F.col("relation").alias("raw")).agg(F.count("*").alias("n")).withColumn("relation", S.normalize_relation(F.col("raw")))


@query(f"SELECT subject_type AS raw, {O.kind('subject_type')} AS type, count(*) AS n FROM triplets GROUP BY 1, 2")
def type_names(spark: SparkSession, sf: str) -> DataFrame:
    """Entity types in the vocabulary's spelling."""
    return table(spark, sf, "triplets").groupBy(F.col("subject_type").alias("raw")).agg(F.count("*").alias("n")).withColumn("type", S.normalize_type(F.col("raw")))


_DOI = "nullif(regexp_replace(lower(trim(doi)), '^(https?://(dx\\.)?doi\\.org/|doi:\\s*)', ''), '')"


@query(f"SELECT rec_id, {_DOI} AS doi, coalesce({_DOI}, upper(nullif(pmcid, '')), 'PMID:' || nullif(pmid, ''), 'hash:' || substr(sha1(coalesce(title, '')), 1, 16)) AS paper_id, {O.year('year')} AS year FROM paper_records")
def paper_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Stable ids and cleaned years of all records."""
    c = F.col
    return table(spark, sf, "paper_records").select("rec_id", S.normalize_doi(c("doi")).alias("doi"), S.paper_id(c("doi"), c("pmcid"), c("pmid"), c("title")).alias("paper_id"), S.clean_year(c("year")).alias("year"))


_BARE = "regexp_replace(coalesce(title, ''), '<[^>]+>', ' ', 'g')"
for _entity, _sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#61;", "="), ("&micro;", "µ"), ("&nbsp;", " "), ("&amp;", "&")):
    _BARE = f"replace({_BARE}, '{_entity}', '{_sign}')"


@query(f"SELECT rec_id, trim(regexp_replace({_BARE}, '\\s+', ' ', 'g')) AS title FROM paper_records")
def stripped_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles without mark-up and entities."""
    return table(spark, sf, "paper_records").select("rec_id", T.strip_markup(F.col("title")).alias("title"))


@query("SELECT parsed_id, lower(nullif(regexp_extract(markdown, '(?i)\\b(10\\.\\d{4,9}/[^\\s\"<>]+[^\\s\"<>.,;)])', 1), '')) AS doi, substr(regexp_replace(coalesce(paper_id, ''), '[^A-Za-z0-9._-]+', '_', 'g'), 1, 120) AS file FROM parsed_documents")
def document_dois(spark: SparkSession, sf: str) -> DataFrame:
    """DOIs in the texts and file names of the papers."""
    return table(spark, sf, "parsed_documents").select("parsed_id", S.extract_doi(F.col("markdown")).alias("doi"), S.safe_name(F.coalesce("paper_id", F.lit(""))).alias("file"))


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS tokens FROM documents WHERE text IS NOT NULL")
def document_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct tokens of every document."""
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.size(S.tokens(F.col("text"))).cast("bigint").alias("tokens"))


@query()
def paper_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of all parsed documents with section and index."""
    docs = table(spark, sf, "parsed_documents").select("parsed_id", F.explode(T.build_chunks()(F.col("markdown"))).alias("c"))
    return docs.select("parsed_id", "c.index", "c.section", "c.text")


_BAG = "list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'))"


@query(r"""WITH pa AS (SELECT paper_id, arg_max(nullif(abstract, ''), (landed_at, rec_id)) FILTER (nullif(abstract, '') IS NOT NULL) AS abstract FROM paper_records WHERE paper_id IS NOT NULL GROUP BY 1),
j AS (SELECT row_number() OVER () AS rid, t.paper_id, seq, subject, object, regexp_replace(coalesce(abstract, ''), '\s+', ' ', 'g') AS flat, trim(regexp_replace(coalesce(provenance_snippet, ''), '\s+', ' ', 'g')) AS want FROM triplets t JOIN pa USING (paper_id)),
b AS (SELECT *, list_distinct(list_concat({bag_s}, {bag_o}, {bag_w})) AS words, want <> '' AND contains(lower(flat), lower(want)) AS held FROM j),
s AS (SELECT rid, words, string_split(regexp_replace(flat, '([.!?])\s+([A-Z0-9(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS parts FROM b WHERE NOT held),
u AS (SELECT rid, words, trim(unnest(parts)) AS part, unnest(range(len(parts))) AS i FROM s),
m AS (SELECT rid, arg_max(part, (len(list_intersect({bag_p}, words)) / greatest(len(words), 1), -i)) AS part, max(len(list_intersect({bag_p}, words)) / greatest(len(words), 1)) AS score FROM u WHERE part <> '' GROUP BY 1)
SELECT paper_id, seq, subject, object, CASE WHEN held THEN want WHEN score >= 0.3 THEN part ELSE '' END AS snippet FROM b LEFT JOIN m USING (rid)""".replace("{bag_s}", _BAG.format("subject")).replace("{bag_o}", _BAG.format("object")).replace("{bag_w}", _BAG.format("want")).replace("{bag_p}", _BAG.format("part")))
def snippets_verified(spark: SparkSession, sf: str) -> DataFrame:
    """Snippets of the triplets held against the abstracts of their papers."""
    texts = papers(spark, sf).select("paper_id", F.coalesce("abstract", F.lit("")).alias("abstract"))
    joined = table(spark, sf, "triplets").join(texts, "paper_id")
    return joined.select("paper_id", "seq", "subject", "object", T.find_snippet("provenance_snippet", "abstract", "subject", "object").alias("snippet"))


@query("WITH f AS (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, t, greatest(0, coalesce(nullif(instr(lower(t), 'gland'), 0) - 1, 0) - 70) AS s FROM f) SELECT doc_id, CASE WHEN length(t) <= 280 THEN t ELSE CASE WHEN s > 0 THEN '…' ELSE '' END || trim(substr(t, s + 1, 280), ' ' || chr(9) || chr(10) || chr(13)) || CASE WHEN s + 280 < length(t) THEN '…' ELSE '' END END AS snippet FROM p")
def document_snippets(spark: SparkSession, sf: str) -> DataFrame:
    """A window of every document around a term."""
    return table(spark, sf, "documents").where("text is not null").select("doc_id", S.snippet_around(F.col("text"), F.array(F.lit("gland"))).alias("snippet"))


@query()
def linked_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Entities named in every document."""
    return E.link_in_text(table(spark, sf, "documents").select("doc_id", "text"), E.alias_index(table(spark, sf, "entities")), "doc_id", "text")


@query("WITH t AS (SELECT rec_id, trim(coalesce(abstract, ''), ' ' || chr(9) || chr(10) || chr(13)) AS a, coalesce(title, '') AS title FROM paper_records), r AS (SELECT rec_id, CASE WHEN a <> '' THEN title || chr(10) || chr(10) || 'Abstract' || chr(10) || a ELSE '' END AS x FROM t) SELECT CASE WHEN length(x) < 100 THEN 'no_text' ELSE 'ok' END AS status, count(*) AS papers FROM r GROUP BY 1")
def routed_papers(spark: SparkSession, sf: str) -> DataFrame:
    """How many records have enough text to read."""
    trimmed = F.btrim(F.coalesce("abstract", F.lit("")), F.lit(" \t\r\n"))
    records = table(spark, sf, "paper_records").select("title", trimmed.alias("abstract"), F.lit(None).cast("string").alias("full_text"))
    return X.text_route(records).groupBy("status").agg(F.count("*").alias("papers"))


# Composites -----------------------------------------------------------------------------------------------------


@query()
def search_papers(spark: SparkSession, sf: str) -> DataFrame:
    """Papers around an entity, with snippets and the entity they are reached through; none if it is unknown."""
    return R.search(snapshot(spark, sf), SEED)["papers"].select("paper_id", "n", "year", "via", "snippet_html")


@query(O.ROWS + _PATHS + " SELECT rank::INTEGER AS rank, (i - 1)::INTEGER AS i, source, type, target, round(confidence, 6) AS confidence, support FROM walk")
def bridge_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Steps of the cheapest paths between two entities; none if either is unknown, and never those of a name that is only near."""
    e = cut(edges(spark, sf))
    steps = R.path_steps(e, cut(G.shortest_paths(e, SEED, OTHER, k=3, max_hops=4)))
    return steps.select("rank", "i", "source", "type", "target", F.round("confidence", 6).alias("confidence"), "support")


@query()
def chat_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts for a question about two entities, or about the one that is known."""
    return R.facts(snapshot(spark, sf), [SEED, OTHER])


@query()
def chat_context(spark: SparkSession, sf: str) -> DataFrame:
    """The facts behind a question in words: its entities are found in it, besides the one in focus."""
    found = R.build_context(snapshot(spark, sf), f"Does {OTHER} meet {SEED}?", focus=[SEED])
    return found["facts"].select("place", "source", "type", "target", F.round("confidence", 6).alias("confidence"), "support")


@query()
def search_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes shown for an entity, with those that only predicted links lead to; none if it is unknown."""
    return R.search(snapshot(spark, sf), SEED)["nodes"].select("name", "type", "hop", "parent", "degree")


# Streams over the events table ----------------------------------------------------------------------------------


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE ts IS NOT NULL),
a AS (SELECT user_id, event_id, ts FROM e WHERE rn = 1 UNION ALL SELECT n.user_id, n.x.event_id, n.x.ts FROM (SELECT a.user_id, min({'rn': e.rn, 'event_id': e.event_id, 'ts': e.ts}) AS x FROM a JOIN e ON e.user_id IS NOT DISTINCT FROM a.user_id AND e.ts > a.ts + INTERVAL 3600 SECOND GROUP BY a.user_id) n)
SELECT event_id, event_id IN (SELECT event_id FROM a) AS admitted FROM events""")
def admitted_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events admitted by a sliding window per user, as a fold over the batch."""
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return flows.admissions(events, "user_id", "ts", window=3600.0, limit=1, order="event_id").select("event_id", "admitted")
