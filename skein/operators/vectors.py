"""Text stores with vectors: upserts by content id, filters, and nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import scalars as S


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Chunks (paper_id, index, text, ...) under their content id; of equal ids the last row by index stays."""
    keyed = chunks.withColumn("id", S.stable_id(F.col("paper_id"), F.lit("chunk"), F.col("index"), F.substring("text", 1, 64)))
    return _last(keyed, ["index", "text"])


def provenance_rows(triplets: DataFrame, range_size: int = 1 << 16) -> DataFrame:
    """Snippets of triplets under ids that include the row's place in its paper; blank snippets are no evidence.

    Places are counted in ranges of ``seq`` and shifted by what the paper has in earlier ranges, so a paper with a
    large share of all rows is no single task.
    """
    part = triplets.withColumn("_range", F.floor(F.col("seq") / range_size))
    inside = Window.partitionBy("paper_id", "_range").orderBy("seq", "subject", "relation", "object")
    earlier = Window.partitionBy("_paper").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    counts = part.groupBy(F.col("paper_id").alias("_paper"), F.col("_range").alias("_r")).agg(F.count("*").alias("n"))
    shift = counts.select("_paper", "_r", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_shift"))
    placed = part.withColumn("_place", F.row_number().over(inside) - 1).join(shift, F.col("paper_id").eqNullSafe(F.col("_paper")) & (F.col("_range") == F.col("_r")))
    rows = placed.withColumn("place", F.col("_place") + F.col("_shift")).drop("_range", "_r", "_paper", "_shift", "_place").where(F.trim(F.coalesce("provenance_snippet", F.lit(""))) != "")
    keyed = rows.withColumn("id", S.stable_id(F.col("paper_id"), F.col("subject"), F.col("relation"), F.col("object"), F.col("place"), F.substring("provenance_snippet", 1, 48)))
    return _last(keyed.withColumnRenamed("provenance_snippet", "text"), ["place"])


def _last(rows: DataFrame, order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in rest])


def nearest(store: DataFrame, query: list[float], k: int = 10, vec: str = "embedding", where: Column | None = None, key: str = "id") -> DataFrame:
    """The ``k`` rows nearest to a query vector by cosine, ``score`` rounded to four places; filters come first."""
    found = store if where is None else store.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = found.withColumn("exact", S.cosine(F.col(vec), q)).where("exact is not null")
    return scored.orderBy(F.desc("exact"), key).limit(k).withColumn("score", F.round("exact", 4)).drop("exact")


def nearest_in_blocks(store: DataFrame, queries: DataFrame, k: int, block: int = 50_000, per: str = "query") -> DataFrame:
    """(key, query, cos) of the ``k`` best pairs of every value of ``per`` (key or query), by cosine; ties to the smaller other.

    ``store``: (key, vec); ``queries``: (query, vec). The queries are broadcast in blocks of at most about ``block``
    vectors; every Arrow batch of the store is multiplied with the block and keeps ``k`` pairs a value, which is all
    that is shuffled. Null, empty and zero vectors are near to nothing.
    """
    usable = lambda df: df.where(F.size("vec") > 0)
    held = usable(queries)
    parts = max(1, -(-held.count() // block))
    kind = {f.name: f.dataType.simpleString() for f in [*store.schema, *queries.schema]}
    out = None
    for p in range(parts):
        own = held if parts == 1 else held.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == p)
        names, matrix = [], []
        for r in own.toLocalIterator():
            v = np.array(r["vec"], float)
            n = np.linalg.norm(v)
            if n:
                names.append(r["query"])
                matrix.append(v / n)
        order = sorted(range(len(names)), key=names.__getitem__)
        shared = store.sparkSession.sparkContext.broadcast((np.array(names, object)[order], np.array(matrix)[order] if matrix else None))

        def best(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, matrix = shared.value
            for batch in batches:
                if matrix is None or batch.empty:
                    continue
                batch = batch.sort_values("key", kind="stable")
                x = np.array(batch["vec"].tolist(), float)
                length = np.linalg.norm(x, axis=1)
                x, keys = x[length > 0] / length[length > 0, None], batch["key"].to_numpy()[length > 0]
                cos = x @ matrix.T
                if per == "query":
                    cos = cos.T
                top = np.argsort(-cos, axis=1, kind="stable")[:, :k]
                rows, columns = np.repeat(np.arange(len(cos)), top.shape[1]), top.ravel()
                at = (columns, rows) if per == "query" else (rows, columns)
                yield pd.DataFrame({"key": keys[at[0]], "query": names[at[1]], "cos": cos[rows, columns]})

        found = usable(store).mapInPandas(best, f"key {kind['key']}, query {kind['query']}, cos double")
        out = found if out is None else out.unionByName(found)
    other = "key" if per == "query" else "query"
    order = Window.partitionBy(per).orderBy(F.desc("cos"), other)
    return out.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def nearest_each(queries: DataFrame, store: DataFrame, k: int = 5, vec: str = "embedding", key: str = "id") -> DataFrame:
    """(query, key, score): for every query row (query, vec) its ``k`` nearest rows of the store."""
    top = nearest_in_blocks(store.select(F.col(key).alias("key"), F.col(vec).alias("vec")), queries.select("query", "vec"), k)
    return top.select("query", F.col("key").alias(key), F.round("cos", 6).alias("score"))


def counts(**collections: DataFrame) -> DataFrame:
    """(collection, rows) of text stores."""
    every = [df.select(F.lit(name).alias("collection")).groupBy("collection").count() for name, df in collections.items()]
    known = reduce(DataFrame.unionByName, every)
    names = known.sparkSession.createDataFrame([(n,) for n in collections], "collection string")
    return names.join(known, "collection", "left").select("collection", F.coalesce("count", F.lit(0)).alias("rows"))


def edge_filter(source: str | None = None, target: str | None = None, relation: str | None = None, papers: list[str] | None = None) -> Column:
    """Predicate on evidence of a pair, either way; filters that are not given are left out."""
    keep = F.lit(True)
    if source and target:
        keep = keep & (((F.col("subject") == source) & (F.col("object") == target)) | ((F.col("subject") == target) & (F.col("object") == source)))
    if relation:
        keep = keep & (F.col("relation") == relation)
    if papers:
        keep = keep & F.col("paper_id").isin(papers)
    return keep


def edge_evidence(evidence: DataFrame, limit: int, **filters) -> DataFrame:
    """The most confident snippets for an edge."""
    return evidence.where(edge_filter(**filters)).orderBy(F.desc_nulls_last("confidence"), "id").limit(limit)


def evidence_of(edge_papers: DataFrame, evidence: DataFrame, limit: int = 2) -> DataFrame:
    """For every edge its most confident snippets from its own papers and relation; one row (source, type, target, paper_id) per paper."""
    wanted = edge_papers.select("source", "type", "target", "paper_id", F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v"))
    held = evidence.select("id", "text", "confidence", "paper_id", F.col("relation").alias("type"), F.least("subject", "object").alias("u"), F.greatest("subject", "object").alias("v"))
    order = Window.partitionBy("source", "type", "target").orderBy(F.desc_nulls_last("confidence"), "id")
    return wanted.join(held, ["u", "v", "type", "paper_id"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("source", "type", "target", "rank", "id", "paper_id", "confidence", "text")
