"""Schemas of the stored tables, and their creation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "papers": "paper_id string NOT NULL, doi string, pmid string, pmcid string, title string, year int, journal string, abstract string, source string, url string, authors string, created_at timestamp, processed boolean, processed_at timestamp, n_triplets int, n_chunks int",
    "triplets": "paper_id string NOT NULL, seq long NOT NULL, subject string, relation string, object string, confidence double, subject_type string, object_type string, subject_raw string, object_raw string, provenance_snippet string",
    "entities": "name string NOT NULL, type string, aliases array<string>",
    "mentions": "entity string NOT NULL, paper_id string NOT NULL",
    "relations": "source string NOT NULL, type string NOT NULL, target string NOT NULL, confidence double, support int, papers array<string>, conf_sum double, first_year int",
    "chunks": "id string NOT NULL, paper_id string, idx int, section string, text string, embedding array<float>, doi string, title string, year int",
    "provenance": "id string NOT NULL, paper_id string, text string, embedding array<float>, subject string, relation string, object string, confidence double, doi string, title string, year int",
    "predicted": "source string NOT NULL, target string NOT NULL, score double, method string",
}


def ensure(spark: SparkSession, root: str, *names: str) -> None:
    """Create the tables that are not there yet, empty."""
    for name in names or SCHEMAS:
        spark.createDataFrame([], SCHEMAS[name]).write.mode("ignore").parquet(f"{root}/{name}")


def clear(spark: SparkSession, root: str, *names: str) -> None:
    """Make tables empty."""
    for name in names or SCHEMAS:
        spark.createDataFrame([], SCHEMAS[name]).write.mode("overwrite").parquet(f"{root}/{name}")


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table under its schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def store(df: DataFrame, root: str, name: str) -> None:
    """Replace a stored table; columns are taken by name and cast, missing ones are null."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    wanted = StructType.fromDDL(SCHEMAS[name])
    df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]).write.mode("overwrite").parquet(f"{root}/{name}")


def statement(spark: SparkSession, subject: str, relation: str, obj: str, confidence: float, paper_id: str, seq: int = 0) -> DataFrame:
    """One statement as an insertable triplet: names in lower case, the relation in upper case with bars below."""
    row = (paper_id, seq, subject.strip().lower(), relation.strip().upper().replace(" ", "_"), obj.strip().lower(), float(confidence), "Other", "Other", None, None, None)
    return spark.createDataFrame([row], SCHEMAS["triplets"])
