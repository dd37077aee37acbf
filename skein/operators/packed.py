"""Several values packed in one field: one row per value, in list order.

Quoted spans are replaced by indexed placeholders, the rest is split at its delimiters, the spans are put back by
array lookup, and the values are exploded with their positions. Everything is a column expression: one scan, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import let

# Placeholders are MARK index STOP. A MARK that the text already holds is written MARK ESCAPE first, so no text can
# read as a placeholder.
MARK, ESCAPE, STOP = "\ue000", "\ue001", "\ue002"
# A doubled quote inside a span ends one piece and begins the next, so a span is a run of these pieces.
QUOTED = r'"[^"]*+"'
# Delimiters that no name holds; a comma is weighed separately because it also parts a family name from a given name.
# "and" and "&" also stand inside a group's name: there at most one word and the kind of group follow.
GROUP = r"(?:consortium|consort|network|netw|group|grp|collaboration|collab|collective|alliance|team|study|trial|committee)"
# Runs of white space are entered at their beginning only, so that long ones cost no more than their length.
STRONG = rf"[;；|\t\r\n]+|(?<!\s)\s++/\s++|(?:,|(?<![\s,]))\s++(?:&|and|AND)\s++(?!(?:[^\s,;；|]++\s++)?(?i:{GROUP})\.?\s*+(?:[,;；|\t\r\n]|$))"
#: Abbreviations that end a group's name with their own full stop.
ABBREVIATED = r"(?i)\b(?:consort|netw|grp|collab)\.$"
ET_AL = r"(?i)(?<![,\s])[,\s]*+\bet\.?\s++al\b\.?\s*+$"
EDGES = r"^[\s\p{Z}]++|(?<![\s\p{Z}])[\s\p{Z}]++$"
#: Particles that stand before a family name, and titles that stay behind a given name.
PARTICLES = ("van", "von", "de", "del", "della", "der", "den", "di", "da", "dos", "du", "la", "le", "ter", "ten", "zu")
TITLES = ("MD", "PhD")
# Parts are judged word by word, with patterns whose time is linear and whose depth does not grow with the text.
WORD = r"^[\p{L}\p{M}0-9][\p{L}\p{M}0-9'’\-]++$"
INITIAL = r"^\p{Lu}\p{M}*+\.$"
#: Initials: capitals with their marks, each perhaps dotted, with spaces or hyphens between.
INITIALS, NO_INITIALS = r"^\p{Lu}[\p{Lu}\p{M}.\s\-]*+$", r"[.\s\-][.\p{M}]"
#: A word and its undotted initials: a whole name.
WITH_INITIALS = r"^(?>.*?[\p{L}\p{M}0-9]{2}).*\s(?:\p{Lu}\p{M}*+[\s\-]?){1,4}$"


def _judged(part: Column) -> Column:
    """(text, bare, opens, given): a part of a list between commas.

    ``bare``: one family name; ``opens``: that, or two plain words, which may be a family name with a space in it or
    a given and a family name, but not a whole name; ``given``: only given names or initials.
    """

    def kinds(words: Column) -> Column:
        n = F.size(words)
        first = F.array_position(F.transform(words, lambda w: F.lower(w).isin(*PARTICLES)), F.lit(False)).cast("int")
        family = F.when(first == 0, F.slice(words, n, F.lit(1))).otherwise(F.slice(words, F.greatest(first, F.lit(1)), n))
        plain = lambda ws: F.forall(ws, lambda w: w.rlike(WORD))
        initials = lambda text: text.rlike(INITIALS) & ~text.rlike(NO_INITIALS)
        named = lambda ws: F.element_at(ws, 1).rlike(WORD) & F.forall(F.slice(ws, F.lit(2), F.greatest(F.size(ws), F.lit(1))), lambda w: w.rlike(INITIAL))
        given = lambda ws: initials(F.array_join(ws, " ")) | named(ws)
        untitled = (n > 1) & F.element_at(words, -1).isin(*TITLES)
        few = let(family, lambda f: F.struct(((F.size(f) == 1) & plain(f)).alias("bare"), ((F.size(f) <= 2) & plain(f)).alias("opens")))
        whole = lambda f: F.struct(
            part.alias("text"), f["bare"].alias("bare"), (f["opens"] & ~part.rlike(WITH_INITIALS)).alias("opens"),
            (given(words) | (untitled & given(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(1)))))).alias("given"),
        )
        return let(few, whole)

    return let(F.filter(F.split(part, r"\s+"), lambda w: w != ""), kinds)


def _join_commas(parts: Column) -> Column:
    """Put a family name and the given name after its comma together again; other commas part names."""
    none = F.lit(None).cast("string")
    start = F.struct(F.array().cast("array<string>").alias("names"), none.alias("open"), F.lit(False).alias("bare"))

    def step(acc: Column, part: Column) -> Column:
        held, text = acc["open"], part["text"]
        joins = held.isNotNull() & (acc["bare"] | part["given"])
        closed = F.when(held.isNotNull(), F.array_append(acc["names"], held)).otherwise(acc["names"])
        state = lambda names, open_, bare: F.struct(names.alias("names"), open_.alias("open"), bare.alias("bare"))
        return (
            F.when(joins, state(F.array_append(acc["names"], F.concat(held, F.lit(","), text)), none, F.lit(False)))
            .when(part["opens"], state(closed, text, part["bare"]))
            .otherwise(state(F.array_append(closed, text), none, F.lit(False)))
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["open"].isNotNull(), F.array_append(acc["names"], acc["open"])).otherwise(acc["names"])

    return F.aggregate(F.transform(parts, _judged), start, step, finish)


def _restore(item: Column, spans: Column) -> Column:
    """Put quoted spans back into an item; enclosing quotes go, doubled quotes inside them become single."""
    one = rf"{MARK}(\d+){STOP}"
    number = lambda p: F.regexp_extract(p, rf"^{one}$", 1)
    back = lambda p: let(number(p), lambda n: F.when(n != "", F.element_at(spans, n.cast("int"))).otherwise(p))
    put = F.array_join(F.transform(F.split(item, rf"(?={MARK}\d)|(?<={STOP})"), back), "")
    bare = lambda x: F.regexp_replace(F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"')), EDGES, "")
    return F.when(~item.contains(MARK), item).when(F.regexp_replace(item, one, "") == "", let(put, bare)).otherwise(put)


def _names(masked: Column) -> Column:
    """Values of a text whose quoted spans are placeholders."""
    segments = F.filter(F.transform(F.split(masked, STRONG, -1), lambda s: F.regexp_replace(s, ET_AL, "")), lambda s: F.trim(s) != "")
    parted = lambda s: _join_commas(F.filter(F.split(s, ","), lambda p: F.trim(p) != ""))
    names = F.flatten(F.transform(segments, lambda s: F.when(s.contains(","), parted(s)).otherwise(F.array(s))))
    return F.transform(names, lambda n: F.regexp_replace(F.regexp_replace(F.regexp_replace(n, EDGES, ""), r"^(?:and|AND|&)\s++", ""), EDGES, ""))


def _unclosed(name: Column) -> Column:
    """The last name of a list without the full stop that closes the list, which that of a dotted initial does not."""
    dotted = r"(?:^|[\s.\-])\p{Lu}\p{M}*\.[\s\-]?\p{Lu}\p{M}*\.$"
    closes = name.endswith(".") & ~name.contains(",") & ~name.rlike(ABBREVIATED) & ~name.rlike(dotted)
    return F.when(closes, F.regexp_replace(name, r"(?<!\s)\s*+\.$", "")).otherwise(name)


def unpack(packed: Column) -> Column:
    """Array of the values in ``packed``, in order; null for null, empty for a text without any value."""

    def values(escaped: Column) -> Column:
        masked = F.array_join(F.transform(F.split(escaped, QUOTED, -1), lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(MARK), i.cast("string"), F.lit(STOP), p))), "")
        spans = F.regexp_extract_all(escaped, F.lit(QUOTED), F.lit(0))
        return let(spans, lambda held: let(_names(masked), lambda names: let(F.size(names), lambda n: F.transform(names, lambda x, i: let(F.when(i == n - 1, _unclosed(x)).otherwise(x), lambda y: _restore(y, held))))))

    found = let(F.replace(packed, F.lit(MARK), F.lit(MARK + ESCAPE)), values)
    whole = F.transform(found, lambda n: F.replace(n, F.lit(MARK + ESCAPE), F.lit(MARK)))
    return F.filter(whole, lambda n: (n != "") & ~n.rlike(r"(?i)^et\.?\s++al\.?$"))


def unpack_rows(df: DataFrame, column: str, value: str = "value", position: str = "pos") -> DataFrame:
    """One row per value packed in ``column``; ``position`` counts from 1.

    Other columns are kept; of those named like ``value`` or ``position`` the new ones win. Null, empty and blank
    fields give no row. Repeated values and repeated rows are kept. An empty table gives an empty table.
    """
    keep = [c for c in df.columns if c not in (value, position)]
    return df.select(*[F.col(f"`{c}`") for c in keep], F.posexplode(unpack(F.col(f"`{column}`"))).alias("_skein_pos", "_skein_value")).select(
        *[F.col(f"`{c}`") for c in keep], (F.col("_skein_pos") + 1).cast("bigint").alias(position), F.col("_skein_value").alias(value)
    )
