"""Queries of the training-data operators, each over whole tables with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import abstracts as bib
from skein.llm.leak import leaks
from skein.llm.names import variant_pairs, variants
from skein.llm.pack import fill_containers, token_count
from skein.llm.spans import shared_runs
from skein.llm.split import split_texts
from skein.llm.survivor import Bundle, survivors
from skein.llm.truncated import truncated
from skein.llm.components import components
from skein.operators.packed import unpack_rows
from skein.session import cut, table

#: Where the public tokenizers are; set SKEIN_TOKENIZERS to use another folder.
TOKENIZERS = os.environ.get("SKEIN_TOKENIZERS", "/opt/tokenizers")


def batched(spark: SparkSession, rows: int = 2000) -> SparkSession:
    """A session like the caller's in which Arrow batches hold at most ``rows`` rows, because single texts may be long."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    held = int(own.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(rows, held) if held > 0 else rows))
    return own


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all long abstracts and parsed documents."""
    spark = batched(spark)
    abstracts = table(spark, sf_dir, "paper_records").select(F.lit("abstract").alias("item"), F.col("rec_id").alias("item_id"), F.col("abstract").alias("text"))
    parsed = table(spark, sf_dir, "parsed_documents").select(F.lit("markdown").alias("item"), F.col("parsed_id").alias("item_id"), F.col("markdown").alias("text"))
    both = split_texts(abstracts, "text").unionByName(split_texts(parsed, "text"))
    return both.select("item", "item_id", "piece", "from_char", "to_char", "piece_text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that had to be split."""
    return p2_pieces(spark, sf_dir).where("piece = 1").select("item", "item_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose abstract was cut off."""
    spark = batched(spark)
    return truncated(table(spark, sf_dir, "paper_records").select("rec_id", "abstract"), "rec_id", "abstract").where("cut").select("rec_id")


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each source's non-empty abstracts that are cut."""
    spark = batched(spark)
    records = table(spark, sf_dir, "paper_records").select("rec_id", "source", "abstract")
    judged = truncated(records, "rec_id", "abstract")
    counts = judged.join(records.select("rec_id", "source"), "rec_id").groupBy("source").agg(F.count("*").alias("abstracts"), F.count_if("cut").alias("cut"))
    return counts.withColumn("share", F.round(F.col("cut") / F.col("abstracts"), 6))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of spellings of one author or group."""
    spark = batched(spark)
    authors = unpack_rows(table(spark, sf_dir, "paper_records").select("authors"), "authors", value="author").select("author")
    return variant_pairs(variants(authors, "author"))


def paper_groups(records: DataFrame) -> DataFrame:
    """(rec_id, component): records of one paper, by DOI, PMCID, PMID, or title and year; single records are left out.

    A title is a stock title when it is a known one, when no year holds half of its records, or when those of its
    records that share a year bear different PMIDs or PMCIDs, so that the most frequent ones hold no more than half of
    them. (DOIs do not tell: a paper's versions have their own.) These shares stay the same when copies multiply.
    """
    year = F.when(F.col("year").between(1801, 2199), F.col("year"))
    keyed = records.select("rec_id", bib.doi(F.col("doi")).alias("doi"), bib.pmcid(F.col("pmcid")).alias("pmcid"), bib.pmid(F.col("pmid")).alias("pmid"), bib.title_key(F.col("title")).alias("title"), year.alias("year"))
    titled = keyed.where("title is not null and year is not null").select("rec_id", "title", "year", "pmcid", "pmid")
    known = [t.replace(" ", "") for t in bib.STOCK_TITLES]
    share = lambda df, *by: df.groupBy(*by).agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    spread = share(titled.groupBy("title", "year").agg(F.count("*").alias("n")), "title").where((2 * F.col("top") < F.col("n")) | F.col("title").isin(known)).select("title")
    borne = titled.select("title", "year", F.posexplode(F.array("pmcid", "pmid")).alias("kind", "value")).where("value is not null")
    together = share(borne.groupBy("title", "year", "kind", "value").agg(F.count("*").alias("n")), "title", "year", "kind").where("n > 1")
    parted = together.groupBy("title", "kind").agg(F.sum("top").alias("top"), F.sum("n").alias("n")).where(2 * F.col("top") <= F.col("n")).select("title")
    stock = spread.unionByName(parted).distinct()
    by_title = titled.join(stock, "title", "left_anti").select(F.col("rec_id").alias("node"), F.concat(F.lit("t"), "title", F.lit("|"), F.col("year").cast("string")).alias("key"))
    by_id = keyed.select(F.col("rec_id").alias("node"), F.explode(F.array(F.concat(F.lit("d"), "doi"), "pmcid", F.concat(F.lit("m"), "pmid"))).alias("key"))
    return components(by_id.unionByName(by_title), "node", "key").withColumnRenamed("node", "rec_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record of every paper with two or more records."""
    spark = batched(spark)
    records = table(spark, sf_dir, "paper_records")
    sources = table(spark, sf_dir, "sources").select("source", F.col("trust").cast("int").alias("trust"))
    groups = paper_groups(records.select("rec_id", "doi", "pmcid", "pmid", "title", "year"))
    slim = records.select("rec_id", bib.doi(F.col("doi")).alias("doi"), bib.pmcid(F.col("pmcid")).alias("pmcid"), "source", "fetched_at", F.char_length(bib.own_text(F.col("abstract"))).alias("own"))
    rows = slim.join(groups, "rec_id").join(sources, "source", "left")
    trusted, latest = 1 / (1 + F.col("trust")), (F.col("fetched_at"),)
    bundles = [
        Bundle("first", ("first_rec",), F.lit(True), (-F.col("first_rec"),)),
        Bundle("doi", ("doi",), F.col("doi").isNotNull(), latest, trusted),
        Bundle("pmcid", ("pmcid",), F.col("pmcid").isNotNull(), latest, trusted),
        Bundle("abstract", ("abstract_rec",), F.col("own") > 0, (trusted, *latest), F.col("own")),
        Bundle("source", ("source",), F.col("source").isNotNull(), (), trusted),
    ]
    rows = rows.withColumn("first_rec", F.col("rec_id")).withColumn("abstract_rec", F.col("rec_id"))
    best = survivors(rows, ["component"], bundles)
    return best.select("first_rec", F.coalesce("doi", F.lit("")).alias("doi"), F.coalesce("pmcid", F.lit("")).alias("pmcid"), F.coalesce("abstract_rec", F.lit(0).cast("bigint")).alias("abstract_rec"), F.coalesce("source", F.lit("")).alias("source"))


def p5_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most trusted consistent identifiers of every title and year: a DOI's PMCID and PMID must stand in a record with it."""
    spark = batched(spark)
    sources = table(spark, sf_dir, "sources").select("source", (10 - F.col("trust")).alias("worth"))
    records = table(spark, sf_dir, "paper_records").where("title is not null and year is not null").join(sources, "source", "left")
    some = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    rows = records.select(F.lower("title").alias("title"), "year", *[some(c).alias(c) for c in ("doi", "pmcid", "pmid", "journal")], F.coalesce("worth", F.lit(0)).alias("worth"))
    bundles = [Bundle(c, (c,), F.col(c).isNotNull(), (), F.col("worth")) for c in ("doi", "pmcid", "pmid", "journal")]
    return survivors(rows, ["title", "year"], bundles, (("doi", "pmcid"), ("doi", "pmid")))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in containers of 2,048 tokens."""
    spark = batched(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sizes = docs.select("doc_id", token_count(F.col("text"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken").alias("tokens"))
    return fill_containers(sizes, "doc_id", "tokens", capacity=2048)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of evaluation items."""
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the share of the item's words that is held, and whether its answer stands behind them."""
    spark = batched(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "eval_items").select("item_id", "text", "answer")
    return leaks(docs, items, "doc_id", "text", "item_id", "text", "answer").withColumn("overlap", F.round("overlap", 6))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of each document that other documents hold word for word."""
    spark = batched(spark)
    return shared_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document with shared stretches is shared elsewhere."""
    spark = batched(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.char_length("text").alias("n"))
    shared = p8_found(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("runs"), F.sum(F.col("to_char") - F.col("from_char")).alias("shared_chars"))
    return shared.join(docs, "doc_id").select("doc_id", "runs", "shared_chars", F.round(F.col("shared_chars") / F.col("n"), 6).alias("share"))


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces, "p3_found": p3_found, "p3_shares": p3_shares, "p4_found": p4_found, "p5_found": p5_found, "p5_identifiers": p5_identifiers, "p6_containers": p6_containers, "p7_found": p7_found, "p7_leaks": p7_leaks, "p8_found": p8_found, "p8_shares": p8_shares}
_SOME = ", ".join(f"nullif(lower(trim({c})), '') AS {c}" for c in ("doi", "pmcid", "pmid", "journal"))
_VALUES = ", ".join(f"v_{c} AS (SELECT title, year, {c}, max(worth) AS t FROM r WHERE {c} IS NOT NULL GROUP BY 1, 2, 3 UNION ALL SELECT DISTINCT title, year, NULL, 0 FROM r)" for c in ("doi", "pmcid", "pmid", "journal"))
SQL: dict[str, str] = {
    "p2_found": "SELECT 'abstract' AS item, rec_id AS item_id FROM paper_records WHERE length(abstract) > 2500 UNION ALL SELECT 'markdown', parsed_id FROM parsed_documents WHERE length(markdown) > 2500",
    # All choices of every group, the inconsistent ones left out.
    "p5_identifiers": f"""WITH r AS (SELECT lower(title) AS title, year, {_SOME}, coalesce(10 - trust, 0) AS worth FROM paper_records LEFT JOIN sources USING (source) WHERE title IS NOT NULL AND year IS NOT NULL), {_VALUES},
c AS (SELECT d.title, d.year, doi, pmcid, pmid, d.t + p.t + m.t AS t FROM v_doi d JOIN v_pmcid p USING (title, year) JOIN v_pmid m USING (title, year)
  WHERE (doi IS NULL OR pmcid IS NULL OR EXISTS (SELECT 1 FROM r WHERE r.title = d.title AND r.year = d.year AND r.doi = d.doi AND r.pmcid = p.pmcid))
  AND (doi IS NULL OR pmid IS NULL OR EXISTS (SELECT 1 FROM r WHERE r.title = d.title AND r.year = d.year AND r.doi = d.doi AND r.pmid = m.pmid))),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title, year ORDER BY t DESC, doi DESC NULLS LAST, pmcid DESC NULLS LAST, pmid DESC NULLS LAST) AS n FROM c) WHERE n = 1),
j AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title, year ORDER BY t DESC, journal DESC NULLS LAST) AS n FROM v_journal) WHERE n = 1)
SELECT title, year, doi, pmcid, pmid, journal FROM b JOIN j USING (title, year)""",
}
