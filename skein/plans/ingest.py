"""From fetched records to graph tables, as one plan over a batch of papers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import entities as E
from skein.operators import extraction as X
from skein.operators import graph as G
from skein.session import cut
from skein.settings import Settings

_D = Settings()


def pending(papers: DataFrame, processed: DataFrame, force: bool = False) -> DataFrame:
    """Papers that still have to be read."""
    return papers if force else papers.join(processed.select("paper_id"), "paper_id", "left_anti")


def chunk_papers(papers: DataFrame, limit: int = _D.chunk_chars, overlap: int = _D.chunk_overlap, most: int | None = _D.max_chunks) -> DataFrame:
    """(paper_id, title, index, section, text) of papers (paper_id, title, text); short texts give one abstract chunk."""
    found = papers.withColumn("chunks", T.build_chunks(limit, overlap, most)(F.col("text")))
    whole = F.array(F.struct(F.lit(0).alias("index"), F.lit("abstract").alias("section"), F.col("text").alias("text")))
    return found.select("paper_id", "title", F.explode(F.when(F.size("chunks") > 0, F.col("chunks")).otherwise(whole)).alias("c")).select("paper_id", "title", "c.*")


def ingest(papers: DataFrame, entities: DataFrame, model: Callable[[str, str | None], str] | None, processed: DataFrame | None = None, force: bool = False, embed=None) -> dict[str, DataFrame]:
    """Runs of a batch: ``status`` per paper, ``chunks``, canonical ``triplets``, and the rows to insert.

    ``papers``: paper_id, title, abstract, full_text, year. Without a model the papers stay unprocessed and can be
    taken up again; papers without enough text are no_text; those already processed are skipped unless forced.
    """
    todo = papers if processed is None else pending(papers, processed, force)
    routed = cut(X.text_route(todo))
    skipped = papers.join(todo.select("paper_id"), "paper_id", "left_anti").select("paper_id", F.lit("skipped").alias("status"))
    chunks = cut(chunk_papers(routed.where("status = 'ok'")))
    if model is None:
        state = routed.select("paper_id", F.when(F.col("status") == "ok", "llm_unavailable").otherwise(F.col("status")).alias("status"))
        return {"status": state.unionByName(skipped), "chunks": chunks}
    keyed = chunks.withColumn("chunk_id", F.concat_ws("#", "paper_id", F.col("index").cast("string")))
    raw = X.extract(keyed, model).withColumn("paper_id", F.substring_index("chunk_id", "#", 1)).withColumn("place", F.substring_index("chunk_id", "#", -1).cast("long") * 1000 + F.col("seq"))
    raw = cut(raw.drop("seq", "text").withColumnRenamed("place", "seq"))
    forms = raw.select(F.explode(F.array("subject", "object")).alias("form"))
    named = E.canonical_triplets(raw, E.resolve(forms, entities, embed)).join(papers.select("paper_id", "year"), "paper_id")
    rows = cut(G.insert_rows(named))
    counts = rows.groupBy("paper_id").agg(F.count("*").alias("n_triplets"))
    state = routed.select("paper_id", "status").join(counts, "paper_id", "left").select("paper_id", "status", F.coalesce("n_triplets", F.lit(0)).alias("n_triplets"))
    return {"status": state.unionByName(skipped.withColumn("n_triplets", F.lit(0).cast("bigint"))), "chunks": chunks, "triplets": named, "rows": rows}


def summary(status: DataFrame) -> DataFrame:
    """(status, papers, triplets) of a run."""
    return status.groupBy("status").agg(F.count("*").alias("papers"), F.sum("n_triplets").alias("triplets"))
