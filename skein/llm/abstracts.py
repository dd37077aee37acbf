"""Identifiers, titles and abstracts of paper records, brought to one notation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entities that stand for one character.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&micro;": "µ", "&ndash;": "–", "&mdash;": "—", "&amp;": "&"}
#: Titles that unrelated papers bear.
STOCK_TITLES = ("untitled", "letter to the editor", "editorial", "corrigendum", "erratum", "correction", "retraction", "book review", "abstracts", "preface", "foreword", "commentary", "reply", "in this issue", "no title")
#: Where one sentence ends and the next begins; an initial ends none.
SENTENCES = r"(?<=[.!?])(?<![\s(]\p{Lu}\.) (?=[\p{Lu}(\[©])"
#: How a publisher's notice begins, and the marks of a cut.
OPENERS = r"(?:\([cC]\)|©|[Cc]opyright\b|This (?:article|work|paper) is|[Ff]urther reproduction|[Pp]ublished (?:under|by|in|with)|[Aa]ll rights reserved|[Rr]eproduced with)"
MARK_OF_A_CUT = r"(?:\.{3,}+|…|[\[(](?i:(?:abstract )?truncated|more|cut|continued|abridged|\.\.\.|…)[\])])"
#: A notice holds no full stop but those inside numbers, addresses and after initials.
NOTICE = rf"{OPENERS}(?:[^.!?]|\.(?=[^\s.…])|(?<=\b\p{{Lu}})\.)*+[.!?]?+"
#: Notices and marks, in any number and order, that close a sentence or are all of it.
CLOSING = rf"(?:(?:(?:^|\s|(?<=\s)){NOTICE}|\s?{MARK_OF_A_CUT})\s*+)++$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def doi(value: Column) -> Column:
    """The DOI from ``10.`` on in lower case; null where there is none."""
    return F.nullif(F.regexp_extract(F.lower(value), r"10\.\d+(?:\.\d+)*/\S+", 0), F.lit(""))


def pmcid(value: Column) -> Column:
    """``PMC`` and its digits; null where there are none."""
    digits = F.regexp_extract(value, r"(?i)^\s*(?:https?://\S*/)?(?:pmc)?\s*:?\s*(?:pmc)?(\d+)(?:\.0)?\s*/?\s*$", 1)
    return F.when(digits != "", F.concat(F.lit("PMC"), digits))


def pmid(value: Column) -> Column:
    """The digits of a PMID; null where there are none, and for zeros."""
    digits = F.regexp_extract(value, r"(?i)^\s*(?:pmid)?\s*:?\s*0*([1-9]\d*)(?:\.0)?\s*$", 1)
    return F.nullif(digits, F.lit(""))


def _numeric(text: Column) -> Column:
    for code in (32, 34, 35, 37, 38, 39, 40, 41, 43, 45, 47, 60, 61, 62, 91, 93, 160, 181):
        text = F.replace(text, F.lit(f"&#{code};"), F.lit(chr(code)))
    return F.regexp_replace(text, r"&#[xX]?[0-9A-Fa-f]+;", "·")


def _named(text: Column) -> Column:
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def unescape(text: Column) -> Column:
    """Entities as the characters they stand for; numeric ones outside ASCII become one mark each."""
    return let(text, lambda t: F.when(t.contains("&"), _named(_numeric(t))).otherwise(t))


def strip_tags(text: Column) -> Column:
    """Text without mark-up tags, entities read."""
    return unescape(let(text, lambda t: F.when(t.contains("<"), F.regexp_replace(t, r"</?[A-Za-z][^<>]*>", "")).otherwise(t)))


def title_key(title: Column) -> Column:
    """A title's letters and digits in lower case; null where none are left."""
    return F.nullif(F.regexp_replace(F.lower(strip_tags(title)), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def plain_text(abstract: Column) -> Column:
    """The abstract without mark-up and entities, white space made single."""
    return F.trim(F.regexp_replace(F.regexp_replace(strip_tags(abstract), r"[\s\p{Z}&&[^ ]]", " "), " {2,}", " "))


def opened(plain: Column) -> Column:
    """(sentences, marked): the sentences of a plain text without the notices and marks of a cut that close it.

    Sentences are taken from the end, in whatever number, while nothing but notices and marks is left of them; the
    last one kept loses those that follow its own words. ``marked`` tells whether a mark of a cut was among them.
    """
    start = lambda s: F.struct(F.size(s).alias("left"), F.lit("").alias("last"), F.lit(False).alias("marked"), F.lit(False).alias("done"))

    def step(acc: Column, sentence: Column) -> Column:
        def judged(closing: Column) -> Column:
            rest = F.rtrim(F.left(sentence, F.char_length(sentence) - F.char_length(closing)))
            seen = acc["marked"] | ((closing != "") & closing.rlike(MARK_OF_A_CUT))
            return let(rest, lambda r: F.struct(F.when(r == "", acc["left"] - 1).otherwise(acc["left"]).alias("left"), r.alias("last"), seen.alias("marked"), (r != "").alias("done")))

        return F.when(acc["done"], acc).otherwise(let(F.regexp_extract(sentence, CLOSING, 0), judged))

    def cleaned(parts: Column) -> Column:
        kept = lambda end: F.when(end["left"] > 0, F.array_append(F.slice(parts, F.lit(1), end["left"] - 1), end["last"])).otherwise(F.array().cast("array<string>"))
        return let(F.aggregate(F.reverse(parts), start(parts), step), lambda end: F.struct(kept(end).alias("sentences"), end["marked"].alias("marked")))

    return let(F.split(plain, SENTENCES), cleaned)


def own_text(abstract: Column) -> Column:
    """The abstract's own text: without mark-up, entities, spacing, marks of a cut and publisher notices."""
    own = F.regexp_replace(F.array_join(opened(plain_text(abstract)).getField("sentences"), " "), r"\s+|[<&][#/]?\p{L}*$", "")
    return F.when(abstract.isNotNull(), own)
