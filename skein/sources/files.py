"""Graphs, texts and PDF files on disk."""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import scalars as S
from skein.functions import text as T


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Stored edges, what is missing filled in."""
    filled = {"confidence": F.lit(0.5), "support": F.lit(1), "papers": F.array().cast("array<string>")}
    return spark.read.parquet(path).withColumns({c: F.coalesce(F.col(c), d) for c, d in filled.items()})


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Stored entities, what is missing filled in."""
    return spark.read.parquet(path).select("name", F.coalesce("type", F.lit("Other")).alias("type"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def write_graph_json(nodes: DataFrame, pairs: DataFrame, path: str) -> None:
    """Nodes (name, type) and pairs (u, v, year) as one JSON object a line: ``{"node": ...}`` and ``{"pair": ...}``."""
    rows = nodes.select(F.struct("name", "type").alias("node"), F.lit(None).alias("pair")).unionByName(
        pairs.select(F.lit(None).cast("struct<name:string,type:string>").alias("node"), F.struct("u", "v", F.col("year").cast("int").alias("year")).alias("pair")), allowMissingColumns=True
    )
    rows.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def write_graph_object(nodes: DataFrame, pairs: DataFrame, path: str) -> None:
    """The graph as one object {names, types, pairs, years}, for tools that read a single file; pairs are places in names.

    Names are in ascending order. The object is one row, so this is for graphs that fit into one file; others are
    written by ``write_graph_json``.
    """
    names = nodes.groupBy("name").agg(F.min("type").alias("type")).agg(F.array_sort(F.collect_list(F.struct("name", "type"))).alias("n"))
    listed = names.select(F.posexplode("n").alias("i", "n")).select("i", "n.name")
    side = lambda c: listed.select(F.col("name").alias(c), F.col("i").alias(f"i_{c}"))
    placed = pairs.join(side("u"), "u").join(side("v"), "v").agg(F.array_sort(F.collect_list(F.struct("i_u", "i_v", F.col("year").cast("int").alias("year")))).alias("p"))
    whole = names.crossJoin(placed).select(  # two single rows
        F.transform("n", lambda x: x["name"]).alias("names"), F.transform("n", lambda x: x["type"]).alias("types"),
        F.transform("p", lambda x: F.array(x["i_u"], x["i_v"])).alias("pairs"), F.transform("p", lambda x: x["year"]).alias("years"),
    )
    whole.coalesce(1).write.mode("overwrite").json(path)


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and pairs written by ``write_graph_json``, or a whole exported object {names, types, pairs, years}."""
    lines = spark.read.schema("node struct<name:string,type:string>, pair struct<u:string,v:string,year:int>, names array<string>, types array<string>, pairs array<array<int>>, years array<int>").option("multiLine", path.endswith(".json")).json(path)
    whole = lines.where("names is not null")
    nodes = lines.where("node is not null").select("node.*").unionByName(whole.select(F.explode(F.arrays_zip("names", "types")).alias("n")).select(F.col("n.names").alias("name"), F.col("n.types").alias("type")))
    listed = whole.select("names", F.explode(F.arrays_zip("pairs", "years")).alias("p")).select(F.col("names")[F.col("p.pairs")[0]].alias("u"), F.col("names")[F.col("p.pairs")[1]].alias("v"), F.col("p.years").alias("year"))
    return nodes, lines.where("pair is not null").select("pair.*").unionByName(listed)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(name, markdown) of every .md file in a folder, each as a whole."""
    files = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1).alias("name"), F.col("value").alias("markdown"))


def write_markdown(papers: DataFrame, path: str) -> None:
    """Papers (paper_id, markdown) in folders by safe name, readable as text."""
    papers.select(S.safe_name(F.col("paper_id")).alias("name"), F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def read_pdfs(spark: SparkSession, path: str, max_bytes: int = 40 << 20) -> DataFrame:
    """(path, content, problem) of a folder's PDF files; ``problem`` names what is too large or no PDF."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    magic = F.substring("content", 1, 4) == F.lit(b"%PDF")
    problem = F.when(F.col("length") > max_bytes, "too large").when(~magic, "no PDF")
    return files.select("path", "content", problem.alias("problem"))


def parse_pdfs(files: DataFrame, margin: float = 0.07, repeat: float = 0.4) -> DataFrame:
    """(path, markdown, n_pages, title, doi) in reading order, running heads dropped. Needs an optional PDF library."""

    @F.pandas_udf("struct<markdown:string,n_pages:int,title:string,doi:string>")
    def parse(contents: pd.Series) -> pd.DataFrame:
        import fitz  # optional

        rows = []
        for content in contents:
            with fitz.open(stream=io.BytesIO(content), filetype="pdf") as pdf:
                pages = [(p.rect.width, p.rect.height, [dict(zip(("x0", "y0", "x1", "y1", "text"), b[:5])) for b in p.get_text("blocks") if b[6] == 0 and b[4].strip()]) for p in pdf]
                rows.append({**document(pages, margin, repeat), "title": (pdf.metadata or {}).get("title") or None})
        return pd.DataFrame(rows, columns=["markdown", "n_pages", "title", "doi"])

    return files.where("problem is null").select("path", parse("content").alias("d")).select("path", "d.*")


def document(pages: list[tuple[float, float, list[dict]]], margin: float = 0.07, repeat: float = 0.4) -> dict:
    """Markdown of pages of text blocks: (width, height, blocks with x0, y0, x1, y1, text)."""
    import re
    from collections import Counter

    key = lambda t: re.sub(r"\d+", "#", re.sub(r"\s+", " ", t.strip().lower()))
    outer = lambda b, h: b["y1"] < h * margin or b["y0"] > h * (1 - margin)
    counts = Counter(k for _, h, blocks in pages for k in {key(b["text"]) for b in blocks if outer(b, h)})
    running = {k for k, n in counts.items() if len(pages) >= 3 and n >= max(2, int(len(pages) * repeat))}
    out = []
    for width, height, blocks in pages:
        for b in T.order_blocks([b for b in blocks if b["text"].strip()], width):
            bare = b["text"].strip()
            if not (outer(b, height) and key(bare) in running) and not re.fullmatch(r"\d{1,4}", bare):
                out.append(T.block_markdown(bare))
    first = " ".join(b["text"] for b in pages[0][2]) if pages else ""
    found = re.search(r"(?i)\b(10\.\d{4,9}/[^\s\"<>]+[^\s\"<>.,;)])", first)
    return {"markdown": "\n\n".join(out), "n_pages": len(pages), "doi": found[1].lower() if found else None}
