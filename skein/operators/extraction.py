"""From a paper's text to validated triplets; the model that proposes them is injected."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import scalars as S
from skein.functions import text as T
from skein.functions import vocabulary as V

ITEM = "struct<subject:string,subject_type:string,relation:string,object:string,object_type:string,confidence:string,provenance_snippet:string>"
PAYLOAD = f"struct<triplets:array<{ITEM}>,relations:array<{ITEM}>>"


def validate(items: DataFrame, min_confidence: float = V.MIN_CONFIDENCE, text: str | None = "text") -> DataFrame:
    """Proposed triplets that hold up, the most confident one per (chunk_id, subject, relation, object).

    ``items``: chunk_id, seq, the fields of a proposal, and the chunk's text if snippets are to be verified.
    """
    kept = items.withColumns({
        "subject": F.btrim("subject"), "object": F.btrim("object"), "relation": S.normalize_relation(F.col("relation")),
        "confidence": F.round(S.clamp(F.coalesce(F.col("confidence").cast("string").try_cast("double"), F.lit(0.6))), 3),
        "subject_type": S.normalize_type(F.col("subject_type")), "object_type": S.normalize_type(F.col("object_type")),
    })
    kept = kept.where((F.col("subject") != "") & (F.col("object") != "") & (F.col("relation") != "") & (F.lower("subject") != F.lower("object")))
    kept = kept.where(S.valid_entity(F.col("subject")) & S.valid_entity(F.col("object")) & (F.col("confidence") >= min_confidence))
    rest = [c for c in kept.columns if c not in ("confidence", "seq")]
    first = F.min(F.struct((-F.col("confidence")).alias("_less"), "seq", *rest)).alias("_b")
    best = kept.groupBy(F.col("chunk_id").alias("_c"), F.lower("subject").alias("_s"), F.col("relation").alias("_r"), F.lower("object").alias("_o")).agg(first)
    best = best.select((-F.col("_b._less")).alias("confidence"), F.col("_b.seq").alias("seq"), *[F.col(f"_b.{c}").alias(c) for c in rest])
    if text is None:
        return best
    return best.withColumn("provenance_snippet", T.find_snippet("provenance_snippet", text, "subject", "object"))


def parse_answers(answers: DataFrame) -> DataFrame:
    """(chunk_id, text, seq, ...): the proposals in a model's answers (chunk_id, text, raw); unreadable ones give none."""
    as_object = S.parse_payload(F.col("raw"), PAYLOAD)
    as_list = S.parse_payload(F.col("raw"), f"array<{ITEM}>")
    read = answers.select("chunk_id", "text", as_object.alias("o"), as_list.alias("l"))
    some = lambda a: F.when(F.size(a) > 0, a)
    items = read.select("chunk_id", "text", F.posexplode(F.coalesce(some(F.col("o.triplets")), some(F.col("o.relations")), some(F.filter("l", lambda x: x["subject"].isNotNull())))).alias("seq", "i"))
    return items.select("chunk_id", "text", "seq", "i.*")


def extract(chunks: DataFrame, model: Callable[[str, str | None], str], min_confidence: float = V.MIN_CONFIDENCE) -> DataFrame:
    """Validated triplets of chunks (chunk_id, title, text); chunks under 40 characters are passed over.

    ``model(text, title)`` returns a JSON answer; it sees the first 6,000 characters, which is the model's limit.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["raw"] = [model(t[:6000], title) for t, title in zip(batch["text"], batch["title"])]
            yield batch[["chunk_id", "text", "raw"]]

    long = chunks.select("chunk_id", "title", F.btrim("text", F.lit(" \t\r\n")).alias("text")).where(F.char_length("text") >= 40)
    return validate(parse_answers(long.mapInPandas(ask, f"chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, text string, raw string")), min_confidence)


def prompt(text: str, title: str | None = None) -> list[dict[str, str]]:
    """Messages that ask a chat model for triplets in the vocabulary."""
    rules = (
        f"Extract (subject, relation, object) statements that the passage makes explicitly. Relations: {', '.join(V.RELATION_TYPES)}. "
        f"Types: {', '.join(V.ENTITY_TYPES)}. Give confidence from 0 to 1 and a sentence copied from the passage. "
        'Answer with JSON: {"triplets": [{"subject", "subject_type", "relation", "object", "object_type", "confidence", "provenance_snippet"}]}.'
    )
    return [{"role": "system", "content": rules}, {"role": "user", "content": (f"Title: {title}\n\n" if title else "") + text}]


def repeated_margins(blocks: DataFrame, ratio: float = 0.4, margin: float = 0.07) -> DataFrame:
    """(doc, text): normalised texts in the page margins that stand on enough of a document's pages.

    ``blocks``: doc, page, height, y0, y1, text. Documents of fewer than three pages have none.
    """
    pages = blocks.groupBy("doc").agg(F.count_distinct("page").alias("pages")).where("pages >= 3")
    edge = blocks.where((F.col("y1") < F.col("height") * margin) | (F.col("y0") > F.col("height") * (1 - margin)))
    seen = edge.groupBy("doc", S.margin_key(F.col("text")).alias("text")).agg(F.count_distinct("page").alias("n"))
    return seen.join(pages, "doc").where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") * ratio))).select("doc", "text")


def text_route(papers: DataFrame) -> DataFrame:
    """Papers with the text to read: the full text, else title and abstract, else none (status no_text)."""
    full = F.btrim(F.coalesce("full_text", F.lit("")), F.lit(" \t\r\n"))
    spare = F.concat(F.coalesce("title", F.lit("")), F.lit("\n\nAbstract\n"), F.coalesce("abstract", F.lit("")))
    text = F.when((F.char_length(full) < 200) & (F.coalesce("abstract", F.lit("")) != ""), spare).otherwise(full)
    return papers.withColumn("text", text).withColumn("status", F.when(F.char_length("text") < 100, "no_text").otherwise("ok"))
