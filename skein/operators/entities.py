"""Entity names: exact keys, synonyms, and similarity against a registry."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import scalars as S
from skein.functions import text as T
from skein.functions import vocabulary as V
from skein.operators.vectors import nearest_in_blocks
from skein.session import cut


def normalized_forms(forms: DataFrame, column: str = "form") -> DataFrame:
    """(form, norm, key) of every distinct non-null form; NFKC runs once per form."""
    distinct = forms.select(F.col(column).alias("form")).where("form is not null").distinct()
    return distinct.withColumn("norm", S.normalize_name(T.nfkc("form"))).withColumn("key", S.match_key(F.col("norm")))


def alias_index(entities: DataFrame) -> DataFrame:
    """(alias, name): lower-case names and aliases; a name beats an alias, the smaller name the larger."""
    named = entities.select(F.lower("name").alias("alias"), F.lit(0).alias("rank"), "name")
    aliased = entities.select(F.explode("aliases").alias("alias"), "name").select(F.lower("alias").alias("alias"), F.lit(1).alias("rank"), "name")
    return named.unionByName(aliased).groupBy("alias").agg(F.min(F.struct("rank", "name")).alias("best")).select("alias", F.col("best.name").alias("name"))


def key_index(entities: DataFrame) -> DataFrame:
    """(key, name): match keys of names and aliases; names beat aliases, smaller names larger ones."""
    listed = entities.select("name", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("i", "form"))
    keyed = listed.select(S.match_key(S.normalize_name(T.nfkc("form"))).alias("key"), F.when(F.col("i") == 0, 0).otherwise(1).alias("rank"), "name").where("key <> ''")
    return keyed.groupBy("key").agg(F.min(F.struct("rank", "name")).alias("best")).select("key", F.col("best.name").alias("name"))


def seed_keys() -> dict[str, str]:
    """Match key of every known synonym and its canonical entity, in plain Python (a fixed small table)."""
    import re

    def norm(x: str) -> str:
        for a, b in V.GREEK.items():
            x = x.replace(a, b)
        return x.lower()

    key = lambda x: re.sub("[^a-z0-9]+", " ", norm(x).replace("'", "")).strip()
    return {key(x): norm(c) for c, more in V.SEED_SYNONYMS.items() for x in [c, *more]}


def resolve_exact(forms: DataFrame, entities: DataFrame, column: str = "form") -> DataFrame:
    """(form, norm, name): registered key, else known synonym (under its registered name, if any), else null."""
    index = cut(key_index(entities))  # looked up twice
    seeds = seed_keys()
    found = normalized_forms(forms, column).where("norm <> ''").join(index, "key", "left")
    seed = S.lookup(seeds, F.col("key"))
    seeded = found.withColumn("seed", seed).withColumn("seed_key", S.match_key(F.col("seed")))
    again = index.select(F.col("key").alias("seed_key"), F.col("name").alias("seed_name"))
    return seeded.join(again, "seed_key", "left").select("form", "norm", F.coalesce("name", "seed_name", "seed").alias("name"))


def best_candidates(names: DataFrame, registry: DataFrame, top_k: int = 5, alpha: float = V.MERGE_ALPHA, threshold: float = V.MERGE_THRESHOLD, block: int = 50_000) -> DataFrame:
    """(norm, candidate, score): for each vectorised name the best registered name at or above the threshold.

    ``names``: (norm, vec); ``registry``: (name, vec), unit vectors. The ``top_k`` nearest by cosine are taken before
    the guards, so a blocked neighbour uses up a place. The registry is met in blocks of at most ``block`` vectors, as
    matrix products in Arrow batches; only ``top_k`` rows a name and block are shuffled.
    """
    top = nearest_in_blocks(names.select(F.col("norm").alias("key"), "vec"), registry.select(F.col("name").alias("query"), "vec"), top_k, block, per="key")
    top = top.select(F.col("key").alias("norm"), F.col("query").alias("candidate"), "cos")
    free = top.where(~S.merge_blocked(F.col("norm"), F.col("candidate")))
    scored = free.withColumn("score", alpha * F.col("cos") + (1 - alpha) * T.jw("norm", "candidate"))
    best = scored.groupBy("norm").agg(F.max(F.struct("score", F.col("candidate"))).alias("b"))
    return best.where(F.col("b.score") >= threshold).select("norm", F.col("b.candidate").alias("candidate"), F.col("b.score").alias("score"))


def hash_embedder(dim: int = 64) -> Callable[[str], list[float]]:
    """A deterministic embedder without a model: character trigrams hashed to signs, unit length."""

    def embed(text: str) -> list[float]:
        import zlib

        vec = [0.0] * dim
        padded = f"  {text} "
        for i in range(len(padded) - 2):
            h = zlib.crc32(padded[i : i + 3].encode())
            vec[h % dim] += 1.0 if (h >> 16) & 1 else -1.0
        norm = sum(v * v for v in vec) ** 0.5 or 1.0
        return [v / norm for v in vec]

    return embed


def with_vectors(df: DataFrame, column: str, embed: Callable[[str], list[float]], vec: str = "vec") -> DataFrame:
    """``df`` with the embedding of a text column."""
    udf = F.pandas_udf(lambda s: s.map(embed), "array<double>")
    return df.withColumn(vec, udf(column))


def resolve(forms: DataFrame, entities: DataFrame, embed: Callable[[str], list[float]] | None = None, column: str = "form") -> DataFrame:
    """(form, norm, name, how) of every distinct form against a registry that stays as it is during the batch.

    Stages: exact key, known synonym, similarity to a registered name, and for the rest the form itself as a new
    entity. Forms that normalise to nothing are left out. Because the registry is frozen, the result does not depend
    on the order of the forms; new forms of one batch are only merged by ``resolve_in_order``.
    """
    exact = resolve_exact(forms, entities, column)
    how = lambda known, other: F.when(known, "exact").otherwise(other)
    if embed is None:
        return exact.select("form", "norm", F.coalesce("name", "norm").alias("name"), how(F.col("name").isNotNull(), F.lit("new")).alias("how"))
    exact = cut(exact)
    vectors = with_vectors(exact.where("name is null").select("norm").distinct(), "norm", embed)
    close = best_candidates(vectors, with_vectors(entities.select("name"), "name", embed))
    other = F.when(F.col("candidate").isNull(), "new").otherwise("similar")
    return exact.join(close, "norm", "left").select("form", "norm", F.coalesce("name", "candidate", "norm").alias("name"), how(F.col("name").isNotNull(), other).alias("how"))


def resolve_in_order(forms: list[str], registry: list[tuple[str, list[str]]], embed: Callable[[str], list[float]], alpha: float = V.MERGE_ALPHA, threshold: float = V.MERGE_THRESHOLD, top_k: int = 5) -> list[tuple[str, str]]:
    """(name, norm) of each form, in order, each new form joining the registry at once.

    The order-dependent rule for one paper's handful of forms, as an ingest of one paper needs it; batches over a
    corpus use ``resolve``.
    """
    import re
    import unicodedata

    def norm(x: str) -> str:
        t = unicodedata.normalize("NFKC", x or "")
        for a, b in V.GREEK.items():
            t = t.replace(a, b)
        t = re.sub(r"\s+", " ", t.lower().replace("’", "'").replace("`", "'").replace("_", " ")).strip(" \t\r\n.,;:()[]{}\"'")
        return re.sub(r"^(?:the|an?)\s+", "", t)

    key = lambda x: re.sub("[^a-z0-9]+", " ", norm(x).replace("'", "")).strip()
    stems = lambda x: {t[:-1] if len(t) > 3 and t.endswith("s") else t for t in re.findall("[a-z0-9]+", x.lower())}
    digits = lambda x: sorted(re.findall(r"\d+", x))
    names: dict[str, list[float]] = {}
    keys: dict[str, str] = {}
    seeds = seed_keys()

    def register(name: str, more: list[str] = ()) -> None:
        names[name] = embed(name)
        keys[key(name)] = name
        for m in more:
            keys.setdefault(key(m), name)

    for name, more in registry:
        register(name, more)
    out = []
    for form in forms:
        n = norm(form)
        if not n:
            out.append(("", ""))
            continue
        hit = keys.get(key(n)) or (keys.get(key(seeds[key(n)]), seeds[key(n)]) if key(n) in seeds else None)
        if hit is None:
            vec = embed(n)
            near = sorted(names, key=lambda c: (-sum(x * y for x, y in zip(vec, names[c])), c))[:top_k]
            blocked = lambda c: digits(n) != digits(c) or min(len(n), len(c)) < 4 or (stems(n) ^ stems(c)) & set(V.MODIFIERS)
            scored = [(alpha * sum(x * y for x, y in zip(vec, names[c])) + (1 - alpha) * T.jaro_winkler(n, c), c) for c in near if not blocked(c)]
            best = max(scored, default=(0.0, ""))
            hit = best[1] if best[1] and best[0] >= threshold else n
        if hit not in names:
            register(hit)
        keys.setdefault(key(n), hit)
        out.append((hit, n))
    return out


def canonical_triplets(triplets: DataFrame, names: DataFrame) -> DataFrame:
    """Triplets with ``subject`` and ``object`` replaced by their names and the normalised forms kept as raw ones.

    ``names``: (form, norm, name). Rows whose subject or object has no name, or both the same, are dropped.
    """
    side = lambda s: names.select(F.col("form").alias(s), F.col("norm").alias(f"{s}_raw"), F.col("name").alias(f"{s}_name"))
    joined = triplets.join(side("subject"), "subject").join(side("object"), "object").where("subject_name <> object_name")
    rest = [c for c in triplets.columns if c not in ("subject", "object")]
    return joined.select(F.col("subject_name").alias("subject"), F.col("object_name").alias("object"), "subject_raw", "object_raw", *rest)


def link_in_text(texts: DataFrame, aliases: DataFrame, key: str, column: str, max_words: int = 6, max_aliases: int = 200_000) -> DataFrame:
    """(key, i, name): entities named in each text, longest match first, in order of first mention.

    ``aliases``: (alias, name). Up to ``max_aliases`` rows the dictionary is held by every task; beyond that the
    texts' word runs are joined with it and only the matches reach the pass that settles overlaps.
    """
    import re

    word = re.compile("[A-Za-z0-9α-ωΑ-Ω][A-Za-z0-9'’\\-+α-ωΑ-Ω]*")

    def settle(words: list[str], names: dict[str, str]) -> list[str]:
        found: dict[str, None] = {}
        i = 0
        while i < len(words):
            for n in range(min(max_words, len(words) - i), 0, -1):
                run = " ".join(words[i : i + n])
                if (n > 1 or len(run) > 2) and run in names:
                    found.setdefault(names[run])
                    i += n
                    break
            else:
                i += 1
        return list(found)

    split = lambda t: [w.replace("’", "'") for w in word.findall((t or "").lower())]
    slim = texts.select(F.col(key).alias("k"), F.col(column).alias("t"))
    known = aliases.groupBy("alias").agg(F.min("name").alias("name"))
    if known.limit(max_aliases + 1).count() <= max_aliases:
        table = texts.sparkSession.sparkContext.broadcast({r["alias"]: r["name"] for r in known.toLocalIterator()})
        found = F.pandas_udf(lambda s: s.map(lambda t: settle(split(t), table.value)), "array<string>")
        return slim.select(F.col("k").alias(key), F.posexplode(found("t")).alias("i", "name"))
    # Texts under one key may be several, so what is matched belongs to the text, which its hash and length name.
    slim = slim.withColumn("id", F.struct(F.xxhash64("t"), F.length("t")))
    runs = F.pandas_udf(lambda s: s.map(lambda t: sorted({" ".join(w[i : i + n]) for w in [split(t)] for i in range(len(w)) for n in range(1, max_words + 1) if i + n <= len(w)})), "array<string>")
    once = slim.select("id", "t").where("t is not null").dropDuplicates(["id"])
    hits = once.select("id", F.explode(runs("t")).alias("alias")).join(known, "alias").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("alias", "name"))).alias("names"))
    found = F.pandas_udf(lambda t, m: pd.Series([settle(split(x), dict(y)) for x, y in zip(t, m)]), "array<string>")
    return slim.join(hits, "id").select(F.col("k").alias(key), F.posexplode(found("t", "names")).alias("i", "name"))
