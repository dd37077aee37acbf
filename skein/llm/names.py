"""Variant spellings of names typed by people: subsequence blocking and longest-common-subsequence ratio.

Values are taken apart into family name, given name and initials; the given names are learned from the values whose
form leaves no doubt. Values of equal parts are one node. Distinct family names are blocked by runs of their rarest
letters (``subsequence_keys``), which any two of a high enough ratio share, and compared; nodes of one or of two near
family names meet under further fields: given names that are the same, near or nicknames, or initials of which one has
all of the other's. Pairs whose given names agree as well are linked, and linked nodes form the name's variants.
"""

from __future__ import annotations

import math
import re
import unicodedata
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.components import components
from skein.session import cut

RATIO, GROUP_RATIO = 0.8, 0.9
#: Letters of a block key, keys of a name for one length of its partner, and families that a block compares at once.
LETTERS, KEYS, MOST = 6, 500, 200
#: Letters from rare to common; any order gives the same pairs.
RARITY = {c: i for i, c in enumerate("qxjzvwkbpgyfmhdclsnrtuoiae")}
#: Particles of family names, titles, and words by which a group is known.
PARTICLES = frozenset("van von de del della der den di da dos du la le ter ten zu".split())
TITLES = frozenset("md phd dr prof msc bsc rn jr sr dphil frcp".split())
GROUP_WORDS = {"consortium": "consortium", "consort": "consortium", "network": "network", "netw": "network", "group": "group", "grp": "group", "collaboration": "collaboration", "collab": "collaboration", "collective": "collective", "alliance": "alliance", "team": "team", "initiative": "initiative", "committee": "committee", "investigators": "investigators"}
SMALL_WORDS = frozenset("the and of for on in".split())
#: Short forms of given names and the names they stand for.
NICKNAMES = {
    "abby": "abigail", "al": "alexander albert", "alex": "alexander alexandra", "andy": "andrew", "annie": "anne", "barb": "barbara", "becky": "rebecca", "bella": "isabella", "ben": "benjamin",
    "bert": "albert robert", "beth": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "cathy": "catherine", "charlie": "charles", "chris": "christopher christine",
    "cindy": "cynthia", "connie": "constance", "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "dick": "richard", "don": "donald", "dora": "theodora dorothea", "dot": "dorothea dorothy",
    "dottie": "dorothea dorothy", "ed": "edward", "eddie": "edward", "ellie": "eleanor", "etta": "henrietta", "fran": "francesca frances", "frank": "francis", "fred": "frederick", "gabby": "gabriella", "greg": "gregory",
    "hal": "harald harold", "hank": "henry", "harry": "harald harold henry", "hetty": "henrietta", "izzy": "isabella", "jack": "john", "jen": "jennifer", "jenny": "jennifer", "jerry": "gerald", "jim": "james", "joe": "joseph", "jon": "jonathan",
    "kate": "katherine", "kathy": "katherine", "katie": "katherine", "ken": "kenneth", "larry": "lawrence", "len": "leonard", "lenny": "leonard", "leo": "leonard", "liz": "elizabeth", "lizzie": "elizabeth", "maggie": "margaret", "mandy": "amanda",
    "matt": "matthew", "meg": "margaret", "mick": "michael", "mike": "michael", "mina": "wilhelmina", "molly": "mary", "nat": "nathaniel", "nate": "nathaniel", "ned": "edward", "nick": "nicholas", "nicky": "nicholas", "ollie": "oliver",
    "pam": "pamela", "pat": "patricia patrick", "patty": "patricia", "peg": "margaret", "peggy": "margaret", "pete": "peter", "phil": "philip", "pippa": "philippa", "polly": "mary", "ray": "raymond", "reggie": "reginald", "rich": "richard", "rick": "richard",
    "rob": "robert", "ron": "ronald", "ronnie": "ronald", "sally": "sarah", "sam": "samuel samantha", "sandy": "alexander alexandra", "steve": "steven stephen", "sue": "susanna susan", "susie": "susanna susan", "ted": "edward theodore theodora", "terry": "terence theresa",
    "thea": "theodora dorothea", "theo": "theodore theodora", "tim": "timothy", "tina": "christina", "tom": "thomas", "tommy": "thomas", "tony": "anthony", "trish": "patricia", "val": "valentina valerie", "vicky": "victoria", "vic": "victoria victor", "wendy": "gwendolyn",
    "will": "william", "willie": "william", "yola": "yolanda", "zach": "zachary", "zack": "zachary", "xen": "xenia", "sanna": "susanna", "tess": "theresa", "toby": "tobias", "jules": "julius julian", "irene": "irena", "mattie": "matthew matilda", "quin": "quentin",
}


def fold(text: str) -> str:
    """Letters without marks, in their own case."""
    out = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return out.translate(str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ß": "s", "æ": "a", "Æ": "A", "’": "'"}))


def _initial_token(token: str) -> bool:
    return re.fullmatch(r"(?:[A-Z]\.?-?){1,4}", token) is not None


def _family(words: list[str]) -> str:
    plain = [w for w in words if w.lower() not in PARTICLES] or words
    plain[0] = re.sub(rf"^(?:{'|'.join(sorted(PARTICLES, key=len, reverse=True))})(?=[A-Z][a-z])", "", plain[0])
    return re.sub(r"[^a-z]", "", "".join(plain).lower().replace("0", "o").replace("1", "i"))


def _given(words: list[str]) -> tuple[str, str]:
    """(first full given name, initials)."""
    name, initials = "", ""
    for w in words:
        if _initial_token(w) and not (len(w) > 2 and not name and "." not in w and w.isupper() and len(w) > 4):
            initials += re.sub("[^A-Z]", "", w)
        else:
            parts = [p for p in re.split(r"[-']", w) if p]
            initials += "".join(p[0].upper() for p in parts)
            name += "".join(parts).lower()
    return name, initials


def parse(value: str) -> dict[str, str]:
    """Parts of a name; ``kind`` is group, sure or doubt (which words are the given name follows from the lexicon)."""
    nick = re.search(r"[\"“(]([^\"”)]+)[\"”)]", value)
    text = fold(re.sub(r"\s*[\"“(][^\"”)]*[\"”)]", " ", value)).strip(" .,;")
    out = {"kind": "sure", "family": "", "given": "", "initials": "", "nick": fold(nick[1]).lower() if nick else "", "words": ""}
    tokens = [re.sub(r"[^a-z]", "", t) for t in re.split(r"[\s\-,&.]+", text.lower())]
    if any(t in GROUP_WORDS for t in tokens):
        parts = sorted(GROUP_WORDS.get(t, t) for t in tokens if t and t not in SMALL_WORDS)
        return out | {"kind": "group", "family": "".join(parts), "initials": "#"}
    if "," in text:
        left, right = (x.split() for x in text.split(",", 1))
        left = [w for w in left if len(w) > 1] or left
        given, initials = _given([w for w in right if w.lower().strip(".") not in TITLES])
        return out | {"family": _family(left) if left else "", "given": given, "initials": initials}
    words = text.split()
    named = [w for w in words if w.lower().strip(".") not in TITLES]
    # "Sr", "Jr" or "MD" after a single word are initials; beside a given and a family name they are titles.
    if sum(len(w) > 2 and w.lower() not in PARTICLES and not w.endswith(".") for w in named) > 1:
        words = named
    if not words:
        return out
    if len(words) == 1:
        return out | {"family": _family(words)}
    lead = next((k for k, w in enumerate(words) if not re.fullmatch(r"[A-Z]|(?:[A-Z]\.-?)+", w)), len(words))
    if 0 < lead < len(words):
        return out | {"initials": _given(words[:lead])[1], "family": _family(words[lead:])}
    tail = len(words)
    while tail > 1 and re.fullmatch(r"[A-Z]{1,4}", words[tail - 1]) and not (tail == 2 and len(words[1]) == 4 and words[0].isupper() and len(words[0]) <= 4):
        tail -= 1
    if tail < len(words):
        return out | {"family": _family(words[:tail]), "initials": "".join(words[tail:])}
    middle = next((k for k, w in enumerate(words) if k and re.fullmatch(r"(?:[A-Z]\.)+", w)), 0)
    if middle and middle < len(words) - 1:
        last = middle
        while last + 1 < len(words) - 1 and _initial_token(words[last + 1]):
            last += 1
        given, initials = _given(words[: last + 1])
        return out | {"given": given, "initials": initials, "family": _family(words[last + 1 :])}
    return out | {"kind": "doubt", "words": " ".join(words)}


def settle(words: str, first: int, two: int, last: int) -> dict[str, str]:
    """Parts of a name of plain words, by how often its first, first two and last words are given names elsewhere."""
    w = words.split()
    if w[0].lower() in PARTICLES or (last > max(first, two) and last):
        rest, names = w[:-1], w[-1:]
    elif len(w) > 2 and two:
        names, rest = w[:2], w[2:]
    else:
        names, rest = w[:1], w[1:]
    given, initials = _given(names)
    return {"family": _family(rest), "given": given, "initials": initials}


def lcs_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths."""
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b))


def agree(family_a: str, given_a: str, initials_a: str, formal_a: str, family_b: str, given_b: str, initials_b: str, formal_b: str) -> bool:
    """Whether two parsed names may be one person's (or one group's)."""
    if (initials_a == "#") != (initials_b == "#"):
        return False
    if lcs_ratio(family_a, family_b) < (GROUP_RATIO if initials_a == "#" else RATIO):
        return False
    if initials_a == "#":
        return True
    if given_a and given_b:
        forms_a, forms_b = {given_a, *formal_a.split()}, {given_b, *formal_b.split()}
        if not forms_a & forms_b and lcs_ratio(given_a, given_b) < RATIO:
            return False
        more_a, more_b = initials_a[1:], initials_b[1:]
        return not more_a or not more_b or more_a.startswith(more_b) or more_b.startswith(more_a) or {more_a[-1:]} == {more_b[-1:]}
    starts_a = {initials_a[:1], *(f[0].upper() for f in formal_a.split())}
    starts_b = {initials_b[:1], *(f[0].upper() for f in formal_b.split())}
    if not starts_a & starts_b:
        return not initials_a and not initials_b
    more_a, more_b = initials_a[1:], initials_b[1:]
    return more_a.startswith(more_b) or more_b.startswith(more_a)


def _paired_givens(parts: DataFrame, least: int = 3, lift: float = 10.0) -> DataFrame:
    """(given, formal): two given names that stand for each other, learned from who bears them.

    Where a family name and further initials are met with exactly two given names, these are one person's more often
    than chance has it if they are a name and its short form. Pairs met ``least`` times and ``lift`` times as often as
    two such names at random are taken, the shorter one as the short form.
    """
    borne = parts.where("family <> '' and length(given) > 1 and length(initials) > 1").groupBy("family", F.expr("substring(initials, 2)").alias("more"))
    pairs = cut(borne.agg(F.min("given").alias("g1"), F.max("given").alias("g2"), F.count_distinct("given").alias("n")).where("n = 2").groupBy("g1", "g2").agg(F.count("*").alias("n")))
    total = pairs.agg(F.sum("n")).first()[0] or 0
    each = pairs.select(F.explode(F.array("g1", "g2")).alias("g"), "n").groupBy("g").agg(F.sum("n").alias("n"))
    side = lambda g: each.select(F.col("g").alias(g), F.col("n").alias(f"n_{g}"))
    often = pairs.where(F.col("n") >= least).join(side("g1"), "g1").join(side("g2"), "g2").where(F.col("n") * F.lit(total) >= lift * F.col("n_g1") * F.col("n_g2"))
    first = F.length("g1") <= F.length("g2")
    return often.select(F.when(first, F.col("g1")).otherwise(F.col("g2")).alias("given"), F.when(first, F.col("g2")).otherwise(F.col("g1")).alias("formal"))


def _nodes(names: DataFrame, column: str, listed: bool = True) -> DataFrame:
    """(name, family, given, initials, formal): every value with its parts."""
    spark = names.sparkSession
    shape = "struct<kind:string,family:string,given:string,initials:string,nick:string,words:string>"
    parsed = F.pandas_udf(lambda s: pd.DataFrame([parse(v) for v in s], columns=["kind", "family", "given", "initials", "nick", "words"]), shape)
    parts = cut(names.select(F.col(column).alias("name"), parsed(F.col(column)).alias("p")).select("name", "p.*"))
    known = spark.createDataFrame(sorted(NICKNAMES.items()) if listed else [], "given string, formal string").select("given", F.explode(F.split("formal", " ")).alias("formal"))
    learned = parts.where("nick <> '' and given <> ''").groupBy(F.col("nick").alias("given"), F.col("given").alias("formal")).count().drop("count")
    quoted = cut(known.unionByName(learned.where("given <> formal")).distinct())
    together = lambda df: df.groupBy("given").agg(F.array_join(F.sort_array(F.collect_set("formal")), " ").alias("formal"))
    nick = together(quoted)
    sure = parts.where("kind = 'sure' and length(given) > 1").groupBy("given").agg(F.count("*").alias("n"))
    lexicon = sure.unionByName(nick.select("given", F.lit(1).cast("bigint").alias("n"))).groupBy("given").agg(F.sum("n").alias("n"))
    letters = lambda w: F.regexp_replace(F.lower(w), "[^a-z]", "")
    split = F.split("words", " ")
    doubt = parts.where("kind = 'doubt'").select("name", "words", letters(split[0]).alias("w1"), letters(F.concat(split[0], split[1])).alias("w2"), letters(F.element_at(split, -1)).alias("w9"))
    for w in ("w1", "w2", "w9"):
        doubt = doubt.join(lexicon.select(F.col("given").alias(w), F.col("n").alias(f"n_{w}")), w, "left")
    settled = F.pandas_udf(lambda a, x, y, z: pd.DataFrame([settle(*v) for v in zip(a, x, y, z)], columns=["family", "given", "initials"]), "struct<family:string,given:string,initials:string>")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    resolved = doubt.select("name", settled("words", zero("n_w1"), zero("n_w2"), zero("n_w9")).alias("p")).select("name", "p.family", "p.given", "p.initials")
    every = cut(parts.where("kind <> 'doubt'").select("name", "family", "given", "initials").unionByName(resolved))
    nick = together(quoted.unionByName(_paired_givens(every)))
    return every.join(nick, "given", "left").withColumn("formal", F.coalesce("formal", F.lit("")))


def subsequence_keys(text: str, ratio: float) -> set[tuple[int, int, str]]:
    """Keys of which two texts share at least one if their ``lcs_ratio`` is ``ratio`` or more.

    Texts of the lengths low and high need a common subsequence of ``least`` letters. Its rarest ``k`` letters, in their
    order, are preceded in rarity by fewer than ``k`` others of it and by at most ``len(text) - least`` letters outside
    it. They are therefore among the ``len(text) - least + k`` rarest of either text, and all orders of choice there are
    keys. Lengths are part of the key, because they settle ``least``.
    """
    m = len(text)
    ranked = sorted(range(m), key=lambda i: (RARITY.get(text[i], -1), text[i], i))
    chosen: dict[tuple[int, int], set[str]] = {}
    out = set()
    for n in range(math.ceil(m * ratio / (2 - ratio) - 1e-9), math.floor(m * (2 - ratio) / ratio + 1e-9) + 1):
        low, high, least = min(m, n), max(m, n), math.ceil(ratio / 2 * (m + n) - 1e-9)
        if not 0 < least <= low:
            continue
        k = min(LETTERS, least)
        while k > 1 and math.comb(high - least + k, k) > KEYS:
            k -= 1
        if (least, k) not in chosen:
            letters = [text[i] for i in sorted(ranked[: m - least + k])]
            chosen[least, k] = set(letters) if k == 1 else {"".join(c) for c in combinations(letters, k)}
        out |= {(low, high, c) for c in chosen[least, k]}
    return out


def _hashes(family: str, grouped: bool) -> list[int]:
    import xxhash

    keys = subsequence_keys(family, GROUP_RATIO if grouped else RATIO)
    return [xxhash.xxh64_intdigest(f"{grouped:d},{low},{high},{c}") - (1 << 63) for low, high, c in keys]


def _near(words: DataFrame, most: int) -> DataFrame:
    """(family, other): every two different words of a high enough ratio in one order; words has (family, grouped).

    A block of more than ``most`` words is compared whole, in a grid of parts of about that many.
    """
    hashes = F.pandas_udf(lambda f, g: pd.Series([_hashes(*v) for v in zip(f, g)]), "array<bigint>")
    keyed = cut(words.select("family", "grouped", F.explode(hashes("family", "grouped")).alias("block")))
    parts = cut(keyed.groupBy("block").count().where("count > 1").select("block", F.ceil(F.col("count") / most).cast("int").alias("parts")))
    keyed = keyed.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("family"), "parts").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = keyed.select("block", "grouped", "family", "part", every.alias("other_part"))
    right = keyed.select("block", F.col("family").alias("other"), F.col("part").alias("other_part"), every.alias("part"))
    least = F.when(F.col("grouped"), GROUP_RATIO).otherwise(RATIO)
    # One substitution costs two letters outside the common subsequence, so the edit distance is never more than these.
    outside = F.floor((1 - least) * (F.length("family") + F.length("other")) + 1e-9).cast("int")
    pairs = left.join(right, ["block", "part", "other_part"]).where("family < other").where(F.levenshtein("family", "other") <= outside)
    pairs = pairs.select("family", "other", least.alias("least")).distinct()
    ratio = F.pandas_udf(lambda a, b: pd.Series([lcs_ratio(*v) for v in zip(a, b)], dtype=float), "double")
    return pairs.where(ratio("family", "other") >= F.col("least")).select("family", "other").distinct()


def _candidates(nodes: DataFrame, most: int) -> DataFrame:
    """(a, b): nodes of near family names that ``agree`` may link.

    Two nodes with given names meet under a given name that both may stand for, or under a pair of near ones. A node
    with initials alone meets those of which it has all initials, or which have all of its own. So a family with one
    first initial and many given names forms no pairs but these.
    """
    named = nodes.where("family <> ''")
    formals = F.filter(F.split("formal", " "), lambda f: f != "")
    givens = named.where("given <> ''")
    same = givens.select("node", "family", F.explode(F.array_distinct(F.concat(F.array("given"), formals))).alias("key"))
    near_given = _near(givens.select(F.col("given").alias("family"), F.lit(False).alias("grouped")).distinct(), most)
    paired = near_given.select(F.explode(F.array("family", "other")).alias("given"), F.concat_ws("|", "family", "other").alias("key"))
    shared = cut(same.unionByName(givens.join(paired, "given").select("node", "family", "key")))
    starts = F.array_distinct(F.concat(F.array(F.substring("initials", 1, 1)), F.transform(formals, lambda f: F.upper(F.substring(f, 1, 1)))))
    whole = named.select("node", "family", (F.col("given") == "").alias("vague"), F.explode(F.transform(starts, lambda x: F.concat(x, F.expr("substring(initials, 2)")))).alias("whole"))
    sizes = F.sequence(F.least(F.lit(1), F.length("whole")), F.length("whole"))
    begun = cut(whole.select("node", "family", "vague", F.explode(F.transform(sizes, lambda n: F.struct(F.substring("whole", F.lit(1), n).alias("key"), (n == F.length("whole")).alias("all")))).alias("k")).select("node", "family", "vague", "k.*"))
    families = named.select("family", (F.col("initials") == "#").alias("grouped")).distinct()
    near = cut(_near(families, most).unionByName(families.select("family", F.col("family").alias("other"))).distinct())
    both = near.unionByName(near.where("family <> other").select(F.col("other").alias("family"), F.col("family").alias("other")))
    to = lambda df, *more: df.select(F.col("node").alias("b"), F.col("family").alias("other"), "key", *more)
    by_given = shared.join(near, "family").withColumnRenamed("node", "a").join(to(shared), ["other", "key"]).where("family <> other or a < b").select("a", "b")
    by_initials = begun.where("vague").join(both, "family").withColumnRenamed("node", "a").join(to(begun, F.col("all").alias("b_all")), ["other", "key"]).where("(all or b_all) and a <> b").select("a", "b")
    return by_given.unionByName(by_initials).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def variants(df: DataFrame, column: str, most: int = MOST, listed: bool = True) -> DataFrame:
    """``(name, entity)``: every distinct value of ``column`` with the entity that it names.

    Null and blank values name nothing and give no row; repeated values count once; values that fit no other are
    entities of their own; an empty table gives none. An initial alone that would fit persons of different middle
    initials under one family name links none of them. Short forms of given names are learned from quoted ones and from
    who bears them; without ``listed`` the list of common ones plays no part.
    """
    names = cut(df.select(F.col(column).alias("name")).where(F.trim("name") != "").distinct())
    found = _nodes(names, "name", listed).withColumn("node", F.xxhash64("family", "given", "initials"))
    found = cut(found)
    nodes = found.groupBy("node").agg(*[F.first(c).alias(c) for c in ("family", "given", "initials", "formal")])
    first = F.substring("initials", 1, 1)
    clash = nodes.where("length(initials) > 1").groupBy("family", first.alias("first")).agg(F.count_distinct(F.substring("initials", 2, 1)).alias("seconds")).where("seconds > 1")
    vague = nodes.where("length(initials) = 1 and given = ''").withColumn("first", first).join(clash, ["family", "first"], "left_semi").select("node")
    nodes = cut(nodes.join(vague, "node", "left_anti"))
    pairs = _candidates(nodes, most)
    side = lambda s: nodes.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("family", "given", "initials", "formal")])
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    ok = F.pandas_udf(lambda *c: pd.Series([agree(*v) for v in zip(*c)], dtype=bool), "boolean")
    linked = near.where(ok(*[F.col(f"{c}_{s}") for s in "ab" for c in ("family", "given", "initials", "formal")])).select("a", "b")
    links = linked.select(F.col("a").alias("node"), F.xxhash64("a", "b").alias("key")).unionByName(linked.select(F.col("b").alias("node"), F.xxhash64("a", "b").alias("key")))
    entities = components(links)
    return found.join(entities, "node", "left").select("name", F.coalesce("component", "node").alias("entity"))


def variant_pairs(found: DataFrame) -> DataFrame:
    """``(name_a, name_b)``: all pairs of values that name one entity, in the order of their bytes."""
    left = found.select("entity", F.col("name").alias("name_a"))
    right = found.select("entity", F.col("name").alias("name_b"))
    return left.join(right, "entity").where("name_a < name_b").select("name_a", "name_b")
