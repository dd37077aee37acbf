"""Scalar column functions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions import vocabulary as V

_STRIP = " \t\r\n.,;:()[]{}\"'"


def lookup(values: dict[str, str | int], key: Column) -> Column:
    """Value of ``key`` in a small literal map; null where it is not there."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def normalize_name(name: Column) -> Column:
    """An entity name for comparison. Expects NFKC text (see ``text.nfkc``); null stays null."""
    for letter, word in V.GREEK.items():
        name = F.replace(name, F.lit(letter), F.lit(word))
    name = F.translate(F.lower(name), "’`_", "'' ")
    name = F.btrim(F.regexp_replace(name, r"(?U)\s+", " "), F.lit(_STRIP))
    return F.regexp_replace(name, r"^(?:the|an?)\s+", "")


def match_key(normalized: Column) -> Column:
    """Key of a normalised name that disregards punctuation."""
    return F.btrim(F.regexp_replace(F.replace(normalized, F.lit("'"), F.lit("")), "[^a-z0-9]+", " "))


def stem_tokens(text: Column) -> Column:
    """Distinct alphanumeric tokens, a final s dropped from those longer than three."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"))
    return F.array_distinct(F.transform(tokens, lambda t: F.when((F.length(t) > 3) & t.endswith("s"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)))


def tokens(text: Column) -> Column:
    """Distinct alphanumeric tokens in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)")))


def digit_signature(text: Column) -> Column:
    """The digit runs of a text, sorted as strings."""
    return F.array_sort(F.regexp_extract_all(text, F.lit(r"(\d+)")))


def merge_blocked(a: Column, b: Column) -> Column:
    """Whether two names must not be merged however similar they are."""
    x, y = stem_tokens(a), stem_tokens(b)
    odd = F.array_union(F.array_except(x, y), F.array_except(y, x))
    return (digit_signature(a) != digit_signature(b)) | (F.least(F.length(a), F.length(b)) < 4) | F.arrays_overlap(odd, F.array(*[F.lit(m) for m in V.MODIFIERS]))


def normalize_relation(relation: Column) -> Column:
    """A relation in the vocabulary's spelling; unknown ones stay unless they are very long; empty for none."""
    r = F.upper(F.btrim(F.regexp_replace(F.coalesce(relation, F.lit("")), "[^A-Za-z0-9]+", "_"), F.lit("_")))
    known = r.isin(V.RELATION_TYPES)
    return F.when(known, r).otherwise(F.coalesce(lookup(V.RELATION_ALIASES, r), F.when(F.length(r) > 40, "ASSOCIATED_WITH").otherwise(r)))


def normalize_type(kind: Column) -> Column:
    """An entity type of the vocabulary, else Other."""
    t = F.btrim(kind)
    t = F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1 << 30)))
    return F.when(t.isin(V.ENTITY_TYPES), t).otherwise("Other")


def valid_entity(name: Column) -> Column:
    """Whether a name is long enough, not too long, not generic, and not digits and punctuation only."""
    n = F.lower(F.btrim(name))
    return F.length(n).between(2, 80) & ~n.isin(V.GENERIC_ENTITIES) & ~n.rlike(r"(?U)^[\d\W_]+$")


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """A number held within bounds; null stays null."""
    return F.when(value < low, low).when(value > high, high).otherwise(value)


def clean_year(value: Column) -> Column:
    """The year in the first four characters, if it lies between 1800 and 2200."""
    year = F.substring(value.cast("string"), 1, 4).try_cast("int")
    return F.when((year > 1800) & (year < 2200), year)


def normalize_doi(doi: Column) -> Column:
    """A DOI without its usual prefixes, in lower case; null for none."""
    return F.nullif(F.regexp_replace(F.lower(F.btrim(doi)), r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", ""), F.lit(""))


def paper_id(doi: Column, pmcid: Column, pmid: Column, fallback: Column) -> Column:
    """Stable identifier: DOI, else PMCID, else PMID, else a hash of ``fallback``."""
    some = lambda c: F.nullif(c, F.lit(""))
    hashed = F.concat(F.lit("hash:"), F.substring(F.sha1(F.coalesce(fallback, F.lit("")).cast("binary")), 1, 16))
    return F.coalesce(normalize_doi(doi), F.upper(some(pmcid)), F.concat(F.lit("PMID:"), some(pmid)), hashed)


def stable_id(*parts: Column) -> Column:
    """SHA-1 of the parts joined by two bars; nulls count as empty."""
    return F.sha1(F.concat_ws("||", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))


def edge_strength(confidence: Column, support: Column) -> Column:
    """How reliable an edge is."""
    return F.greatest(confidence, F.lit(1e-3)) * (1 + F.log(F.greatest(support, F.lit(1)).cast("double")))


def edge_cost(confidence: Column, support: Column) -> Column:
    """Length of an edge on paths, the penalty for a hop included."""
    sure = 1 - (1 - clamp(confidence, 1e-3, 0.999)) / (1 + F.log(F.greatest(support, F.lit(1)).cast("double")))
    return -F.log(sure) + V.HOP_PENALTY


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def extract_doi(text: Column) -> Column:
    """The first DOI in a text, in lower case; null for none."""
    return F.nullif(F.lower(F.regexp_extract(text, r"(?i)\b(10\.\d{4,9}/[^\s\"<>]+[^\s\"<>.,;)])", 1)), F.lit(""))


def safe_name(identifier: Column) -> Column:
    """An identifier as a file name of at most 120 characters."""
    return F.substring(F.regexp_replace(identifier, r"[^A-Za-z0-9._-]+", "_"), 1, 120)


def margin_key(text: Column) -> Column:
    """A running head or foot for comparison across pages: digits masked, spaces single."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.btrim(text, F.lit(_STRIP[:4]))), r"\s+", " "), r"\d+", "#")


def snippet_around(text: Column, terms: Column, width: int = 280) -> Column:
    """A window of ``width`` characters that starts a quarter before the earliest term."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n"))
    first = F.array_min(F.filter(F.transform(terms, lambda x: F.instr(F.lower(t), F.lower(x))), lambda p: p > 0))
    start = F.greatest(F.lit(0), F.coalesce(first - 1, F.lit(0)) - width // 4)
    piece = F.btrim(F.substring(t, start + 1, F.lit(width)), F.lit(" \t\r\n"))
    marked = F.concat(F.when(start > 0, "…").otherwise(""), piece, F.when(start + width < F.char_length(t), "…").otherwise(""))
    return F.when(F.char_length(t) <= width, t).otherwise(marked)


def parse_payload(raw: Column, schema: str) -> Column:
    """A model's JSON answer under ``schema``: code fences dropped, else the outermost object, else the outermost array."""
    bare = F.regexp_replace(F.btrim(raw, F.lit(" \t\r\n")), r"(?i)^```(?:json)?\s*|\s*```$", "")
    inner = lambda a, b: F.regexp_extract(bare, rf"(?s)(\{a}.*\{b})", 1)
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull() & (c != ""), c)
    return F.from_json(F.coalesce(valid(bare), valid(inner("{", "}")), valid(inner("[", "]"))), schema)
