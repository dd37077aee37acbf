"""The knowledge graph as tables: relations with evidence, entities, mentions, and what is derived from them.

Node order is the name in ascending order and input order is ``seq``; both settle every tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import scalars as S
from skein.session import cut


def insert_rows(triplets: DataFrame) -> DataFrame:
    """Triplets as they are written: trimmed, without empty parts and self-loops, confidence clamped, types given."""
    part = lambda c: F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\r\n"))
    kind = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("Other"))
    rows = triplets.withColumns({
        "subject": part("subject"), "object": part("object"), "relation": part("relation"),
        "confidence": S.clamp(F.coalesce("confidence", F.lit(0.5))), "subject_type": kind("subject_type"), "object_type": kind("object_type"),
    })
    return rows.where("subject <> '' and object <> '' and relation <> '' and subject <> object")


def relation_papers(rows: DataFrame) -> DataFrame:
    """One row per (edge, paper): the confidence of the edge's first triplet in the paper, and its earliest year.

    A paper counts once per edge. Only the minimum travels, so a hot edge or paper is combined before the shuffle.
    """
    key = ("source", "type", "target", "paper_id")
    named = rows.select(F.col("subject").alias("source"), F.col("relation").alias("type"), F.col("object").alias("target"), "paper_id", "seq", "confidence", "year")
    return named.groupBy(*key).agg(F.min(F.struct("seq", "confidence")).alias("f"), F.min("year").alias("year")).select(*key, F.col("f.seq").alias("seq"), F.col("f.confidence").alias("confidence"), "year")


def relations(papers: DataFrame, listed: bool = False) -> DataFrame:
    """Edges with support, summed and mean confidence, and first year; ``listed`` adds the papers in first-seen order.

    An edge's list of papers grows with its evidence, so only results that show it ask for it; joins use the rows of
    ``relation_papers``.
    """
    more = [F.transform(F.array_sort(F.collect_list(F.struct("seq", "paper_id"))), lambda p: p["paper_id"]).alias("papers")] if listed else []
    edges = papers.groupBy("source", "type", "target").agg(F.count("*").cast("int").alias("support"), F.sum("confidence").alias("conf_sum"), F.min("year").alias("first_year"), *more)
    return edges.withColumn("confidence", F.col("conf_sum") / F.col("support"))


def merge_relation_papers(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored evidence with a batch merged in: known (edge, paper) pairs keep their confidence, years may fall."""
    key = ["source", "type", "target", "paper_id"]
    both = stored.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    kept = both.groupBy(*key).agg(F.min(F.struct("_new", "seq", "confidence")).alias("f"), F.min("year").alias("year"))
    return kept.select(*key, F.col("f.seq").alias("seq"), F.col("f.confidence").alias("confidence"), "year")


def entity_rows(rows: DataFrame) -> DataFrame:
    """Entities with their first type that is not Other and the raw forms they were met under, in order."""
    side = lambda s, i: F.struct(F.col(s).alias("name"), F.col(f"{s}_type").alias("type"), F.col(f"{s}_raw").alias("raw"), (F.col("seq") * 2 + i).alias("at"))
    met = rows.select(F.explode(F.array(side("subject", 0), side("object", 1))).alias("e")).select("e.*")
    forms = met.groupBy("name", "raw").agg(F.min("at").alias("at"), F.min(F.when(F.col("type") != "Other", F.struct("at", "type"))).alias("t"))
    alias = F.collect_list(F.when(F.col("raw").isNotNull() & (F.col("raw") != F.col("name")), F.struct("at", "raw")))
    out = forms.groupBy("name").agg(F.min("t").alias("t"), F.transform(F.array_sort(alias), lambda a: a["raw"]).alias("aliases"))
    return out.select("name", F.coalesce("t.type", F.lit("Other")).alias("type"), "aliases")


def mentions(rows: DataFrame) -> DataFrame:
    """Distinct (entity, paper_id)."""
    return rows.select(F.explode(F.array("subject", "object")).alias("entity"), "paper_id").distinct()


def upsert_papers(records: DataFrame, order: list[str]) -> DataFrame:
    """Papers by id, each field the last non-empty value in ``order``; years are cleaned."""
    fields = [c for c in ("doi", "pmid", "pmcid", "title", "year", "journal", "abstract", "source", "url", "authors") if c in records.columns]
    value = lambda c: S.clean_year(F.col(c)) if c == "year" else F.nullif(F.col(c), F.lit(""))
    at = F.struct(*order)
    last = [F.max(F.when(value(c).isNotNull(), F.struct(at.alias("at"), value(c).alias("v")))).getField("v").alias(c) for c in fields]
    return records.where("paper_id is not null").groupBy("paper_id").agg(*last)


def mark_processed(papers: DataFrame, runs: DataFrame) -> DataFrame:
    """Papers with their processing state; ``runs``: (paper_id, n_triplets) and, where known, n_chunks and processed_at."""
    more = {"n_chunks": "int", "processed_at": "timestamp"}
    known = runs.withColumns({c: F.lit(None).cast(t) for c, t in more.items() if c not in runs.columns})
    plain = papers.drop("processed", "n_triplets", *more)
    return plain.join(known.select("paper_id", "n_triplets", *more), "paper_id", "left").withColumn("processed", F.col("n_triplets").isNotNull())


def papers_by_id(papers: DataFrame, ids: list[str]) -> DataFrame:
    """The papers of a list of ids in its order, each once; unknown ids are left out."""
    wanted = papers.sparkSession.createDataFrame([(p, i) for i, p in enumerate(dict.fromkeys(ids))], "paper_id string, place int")
    return papers.join(wanted, "paper_id").orderBy("place").drop("place")


def graph_edges(edges: DataFrame) -> DataFrame:
    """Edges as the measures read them: nulls and zeros replaced, self-loops dropped, strength and cost added."""
    some = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit(0).cast(edges.schema[c].dataType)), F.lit(d))
    seen = edges.where("source <> target").withColumns({"confidence": some("confidence", 0.5), "support": some("support", 1)})
    return seen.withColumns({
        "u": F.least("source", "target"), "v": F.greatest("source", "target"),
        "strength": S.edge_strength(F.col("confidence"), F.col("support")), "cost": S.edge_cost(F.col("confidence"), F.col("support")),
    })


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, dst, w): undirected strength, parallel and opposite edges summed. ``edges`` from ``graph_edges``."""
    pairs = edges.groupBy("u", "v").agg(F.sum("strength").alias("w"))
    ends = F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))
    return pairs.select(F.explode(ends).alias("e"), "w").select("e.src", "e.dst", "w")


def degrees(adj: DataFrame) -> DataFrame:
    """(name, degree): distinct neighbours of every connected node."""
    return adj.groupBy(F.col("src").alias("name")).agg(F.count("*").alias("degree"))


def pair_groups(edges: DataFrame) -> DataFrame:
    """(u, v, n, types): the directed edges between two nodes together."""
    return edges.groupBy("u", "v").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("type")).alias("types"), F.min("cost").alias("cost"))


def best_edges(edges: DataFrame) -> DataFrame:
    """The strongest edge of every pair; ties fall to the smaller source, type and target."""
    order = F.struct(-F.col("strength"), "source", "type", "target", "confidence", "support")
    best = edges.groupBy("u", "v").agg(F.min(order).alias("b"))
    return best.select("u", "v", "b.source", "b.type", "b.target", "b.confidence", "b.support")


def pair_years(edges: DataFrame, year: str = "first_year") -> DataFrame:
    """(u, v, year): every linked pair once, with its earliest known year."""
    ends = edges.where("source <> target").select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v"), F.col(year).alias("year"))
    return ends.groupBy("u", "v").agg(F.min("year").alias("year"))


def temporal_split(pairs: DataFrame, cutoff: int) -> DataFrame:
    """Pairs with ``part``: old up to the cutoff (unknown years are old), test beyond it between known nodes.

    Later pairs that touch a node without an old link are left out.
    """
    old = F.coalesce(F.col("year") <= cutoff, F.lit(True))
    before = pairs.where(old)
    nodes = before.select(F.explode(F.array("u", "v")).alias("n")).distinct()
    late = pairs.where(~old).join(nodes.withColumnRenamed("n", "u"), "u", "left_semi").join(nodes.withColumnRenamed("n", "v"), "v", "left_semi")
    return before.select("u", "v", "year", F.lit("old").alias("part")).unionByName(late.select("u", "v", "year", F.lit("test").alias("part")))


def random_split(pairs: DataFrame, val: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    """Pairs (u, v) with ``part`` train, val or test in exact shares (rounded down), in the order of a seeded digest of the pair.

    Where a share ends in that order is found from counts of digests by their first four signs; only the digests of one
    such group, a 65,536th of all, come to the driver.
    """
    digest = F.md5(F.concat_ws("|", "u", "v", F.lit(str(seed))))
    placed = cut(pairs.withColumn("_d", digest))
    by = dict(placed.groupBy(F.substring("_d", 1, 4).alias("g")).count().collect())
    total = sum(by.values())

    def end(share: float) -> str:
        """The digest before which this share of the pairs lies."""
        left = int(total * share + 1e-9)
        for g in sorted(by):
            if left < by[g]:
                return sorted(r["_d"] for r in placed.where(F.col("_d").startswith(g)).select("_d").collect())[left]
            left -= by[g]
        return "g"

    first, second = end(test), end(test + val)
    return placed.withColumn("part", F.when(F.col("_d") < first, "test").when(F.col("_d") < second, "val").otherwise("train")).drop("_d")


def negative_pairs(pairs: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """``count`` different node pairs without a link, drawn with a seed; all there are if the graph has fewer.

    Each round lays two seeded orders of the nodes side by side and draws about a pair a node, until there are enough.
    Where at most four times as many exist as are asked for, all of them are listed and drawn from.
    """
    linked = cut(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct())
    nodes = cut(pairs.select(F.explode(F.array("u", "v")).alias("n")).distinct())
    n, order = nodes.count(), F.xxhash64("u", "v", F.lit(seed))
    free = n * (n - 1) // 2 - linked.count()
    if free <= 0 or count <= 0:
        return linked.limit(0)
    if free <= 4 * count:
        every = nodes.select(F.col("n").alias("u")).join(nodes.select(F.col("n").alias("v")), F.col("u") < F.col("v"))
        return every.join(linked, ["u", "v"], "left_anti").orderBy(order).limit(count)
    buckets, drawn, have, step = max(1, n // 1000), None, 0, 0
    while have < count:
        laid = []
        for side, name in enumerate("ab"):
            h = F.xxhash64("n", F.lit(seed), F.lit(2 * step + side))
            at = Window.partitionBy("bucket").orderBy("h", name)
            laid.append(nodes.select(F.col("n").alias(name), h.alias("h"), F.pmod(F.shiftright(h, 20), F.lit(buckets)).alias("bucket")).withColumn("i", F.row_number().over(at)).select("bucket", "i", name))
        both = laid[0].join(laid[1], ["bucket", "i"]).where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
        fresh = both.join(linked, ["u", "v"], "left_anti")
        drawn = cut((fresh if drawn is None else drawn.unionByName(fresh)).distinct())
        have, step = drawn.count(), step + 1
    return drawn.orderBy(order).limit(count)


def neighbors(edges: DataFrame, adj: DataFrame, name: str, limit: int | None = 50) -> DataFrame:
    """The best edge to every neighbour of a node, by confidence times support; all of them without a limit."""
    own = best_edges(edges.where((F.col("u") == name) | (F.col("v") == name)))
    other = F.when(F.col("u") == name, F.col("v")).otherwise(F.col("u"))
    rated = own.select(other.alias("name"), "type", "source", "target", "confidence", "support", (F.col("confidence") * F.col("support")).alias("rating"))
    ordered = rated.join(degrees(adj), "name", "left").orderBy(F.desc("rating"), "name")
    return ordered if limit is None else ordered.limit(limit)


def edges_between(edges: DataFrame, a: str, b: str) -> DataFrame:
    """All edges between two names, either way."""
    pair = F.col("source").isin(a, b) & F.col("target").isin(a, b) & (F.col("source") != F.col("target"))
    return edges.where(pair)


def papers_for_entities(mentioned: DataFrame, papers: DataFrame, names: DataFrame, limit: int | None = None) -> DataFrame:
    """Papers by how many of ``names`` they mention, later years first (unknown years before all)."""
    hits = mentioned.join(names.select(F.col("name").alias("entity")).distinct(), "entity").groupBy("paper_id").agg(F.array_sort(F.collect_set("entity")).alias("entities"))
    found = papers.join(hits, "paper_id").withColumn("n", F.size("entities")).orderBy(F.desc("n"), F.desc_nulls_first("year"), "paper_id")
    return found if limit is None else found.limit(limit)


def find_entity(entities: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, name): exact name before alias, the smaller name first; ``terms`` has (term). Aliases compare with case."""
    t = terms.select("term", F.lower(F.btrim("term")).alias("t")).where("t <> ''")
    by_name = t.join(entities.select(F.col("name").alias("t")), "t").select("term", F.lit(0).alias("rank"), F.col("t").alias("name"))
    by_alias = t.join(entities.select("name", F.explode("aliases").alias("t")), "t").select("term", F.lit(1).alias("rank"), "name")
    return by_name.unionByName(by_alias).groupBy("term").agg(F.min(F.struct("rank", "name")).alias("b")).select("term", F.col("b.name").alias("name"))


def search_entities(entities: DataFrame, term: str, limit: int = 10) -> DataFrame:
    """Names and aliases with words that begin like the term's words; more words hit, then shorter names, first."""
    wanted = [w for w in term.strip().lower().split() if w]
    if not wanted:
        return entities.select("name", "type", F.lit(0).alias("score")).limit(0)
    words = F.split(F.lower(F.concat_ws(" ", "name", F.concat_ws(" ", "aliases"))), r"[^a-z0-9α-ω]+")
    hit = lambda w: F.exists(words, lambda x: x.startswith(w)).cast("int")
    score = sum((hit(w) for w in wanted[1:]), hit(wanted[0]))
    found = entities.select("name", "type", score.alias("score")).where("score > 0")
    return found.orderBy(F.desc("score"), F.length("name"), "name").limit(limit)


def contains_entities(entities: DataFrame, term: str) -> DataFrame:
    """Names that contain the term, or have an alias that does."""
    t = term.strip().lower()
    return entities.where(F.col("name").contains(t) | F.exists("aliases", lambda a: F.lower(a).contains(t))).select("name", "type")


def adamic_adar(adj: DataFrame, seeds: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """(source, target, score): nodes without a link to ``source`` that share neighbours with it; all sources if no seeds.

    Shared neighbours of degree d count 1 / ln(d + 1), those of degree 1 nothing; sums are squashed to below 1. Nodes
    are numbered first, so that the two steps over a shared neighbour move numbers; ``targets`` (name) are chosen before
    the sums.
    """
    nodes = cut(degrees(adj).withColumn("id", F.monotonically_increasing_id()))
    number = lambda c, n: nodes.select(F.col("name").alias(c), F.col("id").alias(n), F.col("degree").alias(f"{n}_degree"))
    links = cut(adj.join(number("src", "s"), "src").join(number("dst", "d"), "dst").select("s", "d", "s_degree"))
    chosen = lambda wanted: nodes.join(wanted.select("name").distinct(), "name", "left_semi")
    first = links.select(F.col("s").alias("source"), F.col("d").alias("mid"))
    if seeds is not None:
        first = first.join(chosen(seeds).select(F.col("id").alias("source")), "source", "left_semi")
    second = links.where("s_degree >= 2").select(F.col("s").alias("mid"), F.col("d").alias("target"), (1 / F.log(F.col("s_degree") + 1.0)).alias("x"))
    if targets is not None:
        second = second.join(chosen(targets).select(F.col("id").alias("target")), "target", "left_semi")
    reached = first.join(second, "mid").where("source <> target").groupBy("source", "target").agg(F.sum("x").alias("x"))
    fresh = reached.join(links.select(F.col("s").alias("source"), F.col("d").alias("target")), ["source", "target"], "left_anti")
    back = lambda c: nodes.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    named = fresh.join(back("source"), "source").join(back("target"), "target")
    return named.select(F.col("source_name").alias("source"), F.col("target_name").alias("target"), (1 - F.exp(-F.col("x"))).alias("score"))


def top_predictions(scores: DataFrame, top_k: int, min_score: float) -> DataFrame:
    """Each source's best targets: first the top list, then the minimum."""
    order = Window.partitionBy("source").orderBy(F.desc(F.round("score", 9)), "target")
    best = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).drop("rank")
    return best.where(F.col("score") >= min_score).withColumn("method", F.lit("adamic_adar"))


def missing_links(adj: DataFrame, names: DataFrame, top_k: int, min_score: float) -> DataFrame:
    """The likeliest missing links among a set of nodes: first the minimum, then the top list."""
    scores = adamic_adar(adj, names, names).where("source < target")
    return scores.where(F.col("score") >= min_score).orderBy(F.desc(F.round("score", 9)), "source", "target").limit(top_k)


def hubs(adj: DataFrame, count: int) -> DataFrame:
    """The nodes of highest degree."""
    return degrees(adj).orderBy(F.desc("degree"), "name").limit(count)


def materialize_predictions(adj: DataFrame, top_k: int = 5, min_score: float = 0.8, max_nodes: int = 2000) -> DataFrame:
    """Predictions of the hubs, as a table that replaces the last one."""
    return top_predictions(adamic_adar(adj, hubs(adj, max_nodes)), top_k, min_score).select("source", "target", "score", "method")


def pagerank(adj: DataFrame, nodes: DataFrame, seeds: dict[str, float], damping: float = 0.85, steps: int | None = None, tol: float = 1e-9, most: int = 200, missing_ok: bool = False) -> DataFrame:
    """(name, ppr): personalised PageRank over the strength-weighted graph, mass sums to 1.

    ``steps`` runs a fixed number of rounds; else rounds go on until the change is below ``tol``. The mass of nodes
    without links returns to the seeds. Every round's masses are written, so a round reads the one before and no more.
    Where no seed is in the graph there is no mass: an error, or 0 for every node if that is ``missing_ok``.
    """
    spark = adj.sparkSession
    total = sum(seeds.values())
    e = spark.createDataFrame([(k, v / total) for k, v in seeds.items()], "name string, e double")
    out = adj.groupBy("src").agg(F.sum("w").alias("total"))
    move = cut(adj.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("m")))
    base = cut(nodes.select("name").distinct().join(F.broadcast(e), "name", "left").join(out.select(F.col("src").alias("name"), F.lit(True).alias("linked")), "name", "left").select("name", F.coalesce("e", F.lit(0.0)).alias("e"), F.coalesce("linked", F.lit(False)).alias("linked")))
    if base.where("e > 0").limit(1).count() == 0:
        if missing_ok:
            return base.select("name", F.lit(0.0).alias("ppr"))
        raise KeyError("none of the seeds is in the graph")
    p = base.withColumn("p", F.col("e"))
    for _ in range(steps if steps is not None else most):
        gained = move.join(p.select(F.col("name").alias("src"), "p"), "src").groupBy(F.col("dst").alias("name")).agg(F.sum(F.col("m") * F.col("p")).alias("g"))
        lost = p.agg(F.sum(F.when(~F.col("linked"), F.col("p")).otherwise(0.0)).alias("lost"))
        fresh = p.withColumnRenamed("p", "before").join(gained, "name", "left").crossJoin(F.broadcast(lost))
        p = cut(fresh.select("name", "e", "linked", ((1 - damping) * F.col("e") + damping * (F.coalesce("g", F.lit(0.0)) + F.col("lost") * F.col("e"))).alias("p"), "before"))
        if steps is None and p.agg(F.sum(F.abs(F.col("p") - F.col("before")))).first()[0] < tol:
            break
        p = p.drop("before")
    return p.select("name", F.col("p").alias("ppr"))


def way_to(step: DataFrame, target: str, hops: int) -> DataFrame:
    """(name, hop, rest): nodes within ``hops`` of a node, the fewest steps and the least cost of a way there."""
    known = cut(step.sparkSession.createDataFrame([(target, 0, 0.0)], "name string, hop int, rest double"))
    for h in range(1, hops + 1):
        on = step.join(known.select(F.col("name").alias("dst"), "rest"), "dst").select(F.col("src").alias("name"), F.lit(h).alias("hop"), (F.col("rest") + F.col("cost")).alias("rest"))
        known = cut(known.unionByName(on).groupBy("name").agg(F.min("hop").alias("hop"), F.min("rest").alias("rest")))
    return known


def grow(adj: list[tuple[str, str]], ppr: dict[str, float], seed: str, top_k: int, hops: int) -> list[tuple[str, int, str | None]]:
    """(name, hop, parent) of the connected best-first growth from a seed: highest rank first, then name, then parent."""
    import heapq

    near: dict[str, list[str]] = {}
    for a, b in adj:
        near.setdefault(a, []).append(b)
    picked: dict[str, tuple[int, str | None]] = {}
    heap = [(0.0, seed, "", 0)]
    while heap and len(picked) < top_k + 1:
        _, node, parent, hop = heapq.heappop(heap)
        if node in picked:
            continue
        picked[node] = (hop, parent or None)
        if hop < hops:
            for other in near.get(node, []):
                if other not in picked:
                    heapq.heappush(heap, (-ppr.get(other, 0.0), other, node, hop + 1))
    return [(n, h, p) for n, (h, p) in picked.items()]


#: Columns of a connected subgraph.
SUBGRAPH = "name string, hop int, parent string, ppr double"


def local_subgraph(adj: DataFrame, nodes: DataFrame, seed: str, top_k: int = 20, hops: int = 3, steps: int | None = None) -> DataFrame:
    """(name, hop, parent, ppr): the connected subgraph of the ``top_k`` most relevant nodes around a seed.

    From any node no more than its ``top_k + 1`` best neighbours can be picked, so each level is expanded by those
    only and the last, sequential step reads at most (top_k + 1) ** hops rows, whatever the graph's size. A seed without
    links is alone; one that is not among the nodes has no subgraph.
    """
    spark = adj.sparkSession
    if nodes.where(F.col("name") == seed).limit(1).count() == 0:
        return spark.createDataFrame([], SUBGRAPH)
    rank = cut(pagerank(adj, nodes, {seed: 1.0}, steps=steps))
    rim, done = spark.createDataFrame([(seed,)], "src string"), None
    rows = spark.createDataFrame([(seed, None, None)], "src string, dst string, ppr double")
    order = Window.partitionBy("src").orderBy(F.desc("ppr"), "dst")
    for _ in range(hops):
        near = adj.join(rim, "src", "left_semi").join(rank.select(F.col("name").alias("dst"), "ppr"), "dst")
        near = cut(near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top_k + 1).select("src", "dst", "ppr"))
        rows = rows.unionByName(near)
        done = rim if done is None else done.unionByName(rim)
        rim = near.select(F.col("dst").alias("src")).distinct().join(done, "src", "left_anti")

    def pick(pdf):
        import pandas as pd

        pdf = pdf.dropna(subset=["dst"])
        found = grow(list(zip(pdf["src"], pdf["dst"])), dict(zip(pdf["dst"], pdf["ppr"])), seed, top_k, hops)
        return pd.DataFrame(found, columns=["name", "hop", "parent"])

    picked = rows.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(pick, "name string, hop int, parent string")
    return picked.join(rank, "name", "left")


def k_hop_paths(adj: DataFrame, seed: str, hops: int, limit: int | None = None) -> DataFrame:
    """(nodes): the simple paths of 1 to ``hops`` steps from a seed (1 to 5), all or the first ``limit``, shorter ones first."""
    hops = max(1, min(hops, 5))
    level = adj.where(F.col("src") == seed).select(F.array("src", "dst").alias("nodes"))
    out = level
    for _ in range(hops - 1):
        nxt = level.withColumn("src", F.element_at("nodes", -1)).join(adj.select("src", "dst"), "src").where(~F.array_contains("nodes", F.col("dst")))
        level = nxt.select(F.array_append("nodes", F.col("dst")).alias("nodes"))
        out = out.unionByName(level)
    return out if limit is None else out.orderBy(F.size("nodes"), "nodes").limit(limit)


def shortest_paths(edges: DataFrame, source: str, target: str, k: int = 3, max_hops: int = 5) -> DataFrame:
    """(rank, nodes, hops, cost, score, types): the ``k`` cheapest simple paths of at most ``max_hops`` steps.

    Paths are ranked by the cheapest edge of every pair and reported with the strongest one. Prefixes are extended by
    joins. One is given up when it cannot reach the target within the hops left, or when its cost and the least cost
    from its end to the target exceed the ``k``-th best complete path; longer paths are not looked at.
    """
    if source == target:
        return edges.sparkSession.createDataFrame([], "rank int, nodes array<string>, hops int, cost double, score double, types array<string>")
    pair = edges.groupBy("u", "v").agg(F.min("cost").alias("cost"))
    ends = F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))
    step = cut(pair.select(F.explode(ends).alias("e"), "cost").select("e.src", "e.dst", "cost"))
    back = way_to(step, target, max_hops)
    limit, done = None, None
    level = step.where(F.col("src") == source).select(F.array("src", "dst").alias("nodes"), F.col("cost").alias("total"))
    for h in range(1, max_hops + 1):
        level = cut(level)
        hits = level.where(F.element_at("nodes", -1) == target)
        done = hits if done is None else done.unionByName(hits)
        best = [r["total"] for r in done.orderBy("total").limit(k).select("total").collect()]
        limit = best[k - 1] if len(best) >= k else None
        if h == max_hops:
            break
        open_ = level.where(F.element_at("nodes", -1) != target).withColumn("src", F.element_at("nodes", -1))
        nxt = open_.join(step, "src").where(~F.array_contains("nodes", F.col("dst"))).withColumn("total", F.col("total") + F.col("cost"))
        nxt = nxt.join(back.where(F.col("hop") <= max_hops - h - 1).select(F.col("name").alias("dst"), "rest"), "dst")
        if limit is not None:
            nxt = nxt.where(F.col("total") + F.col("rest") <= limit + 1e-9)
        level = nxt.select(F.array_append("nodes", F.col("dst")).alias("nodes"), "total")
    order = Window.orderBy("total", "nodes")
    top = done.orderBy("total", "nodes").limit(k).withColumn("rank", F.row_number().over(order))
    steps = top.select("rank", "nodes", F.posexplode(F.expr("transform(sequence(1, size(nodes) - 1), i -> struct(least(nodes[i-1], nodes[i]) as u, greatest(nodes[i-1], nodes[i]) as v))")).alias("i", "p"))
    strong = best_edges(edges).withColumn("c", S.edge_cost(F.col("confidence"), F.col("support")))
    walked = steps.select("rank", "nodes", "i", "p.u", "p.v").join(strong, ["u", "v"])
    total = walked.groupBy("rank", "nodes").agg(F.array_sort(F.collect_list(F.struct("i", "type", "c", "confidence"))).alias("s"))
    return total.select(
        "rank", "nodes", F.size("s").alias("hops"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x["c"]), 4).alias("cost"),
        F.round(F.aggregate("s", F.lit(1.0), lambda a, x: a * x["confidence"]), 4).alias("score"), F.transform("s", lambda x: x["type"]).alias("types"),
    )


def induced_edges(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with both ends in a set of nodes."""
    n = names.select("name").distinct()
    return edges.join(n.select(F.col("name").alias("source")), "source", "left_semi").join(n.select(F.col("name").alias("target")), "target", "left_semi")


def auc_ap(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(auc, ap): area under the ROC curve by ranks, ties shared, and average precision over distinct scores."""
    by = scored.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(label).cast("double")).alias("p"), F.sum(1.0 - F.col(label).cast("double")).alias("n"))
    by = cut(by)
    low, high = by.agg(F.min("s"), F.max("s")).first()
    width = (high - low) / 1024 if low is not None and high > low else 1.0
    by = by.withColumn("bucket", F.floor((F.col("s") - F.lit(low or 0.0)) / width))
    # Running sums inside 1,024 ranges of scores, plus the totals of the ranges below or above.
    totals = by.groupBy("bucket").agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    low, high = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    totals = totals.select("bucket", zero(F.sum("tn").over(low)).alias("nb0"), zero(F.sum("tp").over(high)).alias("pa0"), zero(F.sum("tn").over(high)).alias("na0"))
    below = Window.partitionBy("bucket").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy("bucket").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    w = by.join(totals, "bucket").withColumns({"nb": F.col("nb0") + zero(F.sum("n").over(below)), "pa": F.col("pa0") + F.sum("p").over(above), "na": F.col("na0") + F.sum("n").over(above)})
    return w.agg((F.sum(F.col("p") * (F.col("nb") + F.col("n") / 2)) / (F.sum("p") * F.sum("n"))).alias("auc"), (F.sum(F.col("p") * F.col("pa") / (F.col("pa") + F.col("na"))) / F.sum("p")).alias("ap"))


def message_features(nodes: DataFrame, adj: DataFrame, vec: str = "vec") -> DataFrame:
    """(name, own, mean): a node's vector and the mean of its neighbours' vectors, one message-passing step."""
    sent = adj.join(nodes.select(F.col("name").alias("dst"), F.posexplode(vec).alias("i", "x")), "dst").groupBy("src", "i").agg(F.avg("x").alias("x"))
    mean = sent.groupBy(F.col("src").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    return nodes.join(mean, "name", "left").select("name", F.col(vec).alias("own"), "mean")


def one_hot(kind: Column, kinds: list[str]) -> Column:
    """A type as a vector with a single one; unknown types count as the last."""
    known = F.when(kind.isin(kinds), kind).otherwise(kinds[-1])
    return F.array(*[F.when(known == k, 1.0).otherwise(0.0) for k in kinds])
