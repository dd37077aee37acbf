"""Text cut off by field limits: near-copies whose alignment ends early, and closing-word terminality.

A cut text is contained in its whole copy, so min-hash bands are taken of whole texts and of their beginnings, each
twice as long as the one before. A record asks for longer texts under the bands of its whole text and of its longest
beginning, which holds at least half of it; every text answers under all of its bands. A bucket's members are aligned
with its longest text; those for which that is no verified near-copy go on to the next longest different text, until
one is verified or none is left. Verified means that 0.8 or more of the shorter text's five-word shingles stand in the
longer one in the same order. A verified record whose alignment ends inside the longer text, other than at the end of a
sentence, was cut.

Where no copy decides, the closing word decides: how often it ends a sentence in the corpus if it has a full stop, how
often it ends a text if it has none. A text without a full stop may close with complete matter (keywords, registrations),
so there the closing word's estimate is the prior for how sentences that begin alike end. All counts cover the whole
corpus and leave the judged record out; rarer evidence weighs less, without thresholds.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm import abstracts as A
from skein.session import cut

SHINGLE, SIMILARITY = 5, 0.8
#: Bands and rows of a whole text and of each beginning; words of the shortest beginning.
BANDS, ROWS = 6, 4
PREFIX_BANDS, PREFIX_ROWS, PREFIX = 2, 4, 16
#: Weight of the prior in the estimates, in observations.
PRIOR = 4.0
#: Signs beyond ASCII that no word holds; ASCII letters and digits, and bytes beyond ASCII, as they are, all others as spaces.
_SIGNS = re.compile(r"[^\x00-\x7f\w]")
_SPACED = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
#: Words whose bands are taken at once.
GROUP = 4096
#: Unfinished mark-up or entity at the end of a text.
BROKEN = r"(?:<[/A-Za-z][^<>]*|</?|(?:^|[\s\d])&#?[A-Za-z0-9]*)$"
#: What closing matter looks like: in brackets, or a label and a colon.
CLOSING_FORM = r"^\(.*\)$|^[^.:]{2,40}:\s\S"
#: Signs that join a word to the next; nothing closes with them.
JOINING = r"[-–—,;:(\[/&+=]$"
TERMINATED = r"[.!?][\"'”’)\]]*$"
_TERMINATED = re.compile(TERMINATED)
#: What a terminated word may end with, and what the word after a sentence begins with; the whole part of a decimal.
_STOPS = frozenset(".!?\"'”’)]")
_NEXT = frozenset(map(chr, [*range(ord("A"), ord("Z") + 1), *range(ord("À"), ord("Þ") + 1), ord("("), ord("[")]))
_DECIMAL = re.compile(r"[(\[]?(\d+\.)\d")
_DIGIT, _CAPITAL, _SMALL = re.compile(r"\d"), re.compile("[A-ZÀ-Þ]"), re.compile(r"[^\W\d_A-ZÀ-Þ]+")


class Hashes(dict):
    """Hashes of words, each taken when it is first met."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def words(text: str) -> list[bytes]:
    """A text's words in small letters."""
    low = text.lower()
    if not low.isascii():
        low = _SIGNS.sub(" ", low)
    return low.encode().translate(_SPACED).split()


def shingles(texts: list[list[bytes]], hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of five words of texts with words, text by text in order, and how many each has; of fewer words, one hash over all."""
    counts = np.array([len(t) for t in texts])
    starts, total = np.cumsum(counts) - counts, int(counts.sum())
    x = np.zeros(total + SHINGLE - 1, np.uint64)
    x[:total] = np.fromiter(map(hashes.__getitem__, chain.from_iterable(texts)), np.uint64, total)
    out, few = x[:total].copy(), []
    for k in range(1, SHINGLE):
        short = starts[counts == k]
        few.append((short, out[short]))
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += x[k : k + total]
    for short, h in few:
        out[short] = h
    out ^= out >> np.uint64(31)
    n = np.maximum(counts - SHINGLE + 1, 1)
    return out[np.arange(total) < np.repeat(starts + n, counts)], n


class Bands:
    """Min-hash bands of texts' shingles: those of the whole, and those of each beginning."""

    def __init__(self) -> None:
        rng = np.random.default_rng(20240501)
        n = max(BANDS * ROWS, PREFIX_BANDS * PREFIX_ROWS)
        self.a = rng.integers(1, 2**63, (n, 1), dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 2**63, (n, 1), dtype=np.uint64)
        self.mix = rng.integers(1, 2**63, max(ROWS, PREFIX_ROWS), dtype=np.uint64) | np.uint64(1)

    def _keys(self, least: np.ndarray, bands: int, rows: int, marks: np.ndarray) -> np.ndarray:
        """Buckets by band and the further axes of ``least``; the lowest byte is the band's mark."""
        h = np.tensordot(self.mix[:rows], least.reshape(bands, rows, *least.shape[1:]), (0, 1))
        return h * np.uint64(0xD6E8FEB86659FD93) & ~np.uint64(255) | marks

    def of(self, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(buckets, places of their texts, whether the text asks under them) of texts that have ``n`` shingles each, together ``s``."""
        ends = [0]  # of the beginnings, in shingles
        while (end := (PREFIX << len(ends) - 1) - SHINGLE + 1) <= n.max():
            ends.append(end)
        offsets, levels = np.array(ends), len(ends) - 1
        low = s * self.a
        low += self.b
        low >>= np.uint64(11)
        inside = offsets < n[:, None]
        parts = np.full((len(low), *inside.shape), np.iinfo(np.uint64).max, np.uint64)
        parts[:, inside] = np.minimum.reduceat(low, (np.cumsum(n)[:, None] - n[:, None] + offsets)[inside], axis=1)
        whole = self._keys(parts[: BANDS * ROWS].min(axis=2), BANDS, ROWS, np.arange(BANDS, dtype=np.uint64)[:, None])
        least = np.minimum.accumulate(parts[: PREFIX_BANDS * PREFIX_ROWS, :, :levels], axis=2)
        marks = np.arange(PREFIX_BANDS, dtype=np.uint64)[:, None, None] + np.arange(32, 32 + 4 * levels, 4, dtype=np.uint64)
        beginnings = self._keys(least, PREFIX_BANDS, PREFIX_ROWS, marks)
        held = offsets[1:] <= n[:, None]
        place, level = np.nonzero(held)
        longest = level == held.sum(axis=1)[place] - 1
        return (
            np.concatenate([whole.ravel(), beginnings[:, held].ravel()]),
            np.concatenate([np.tile(np.arange(len(n)), BANDS), np.tile(place, PREFIX_BANDS)]),
            np.concatenate([np.ones(whole.size, bool), np.tile(longest, PREFIX_BANDS)]),
        )


def shape(token: str) -> str:
    """A token's form: digits, capitals and runs of small letters each as one sign."""
    if token.isascii() and token.isalpha() and token.islower():
        return "a"
    return _SMALL.sub("a", _CAPITAL.sub("A", _DIGIT.sub("9", token)))


def _scan(texts: DataFrame) -> DataFrame:
    """One pass over the texts (k, body); rows by ``kind``.

    0: a band of a text (a: bucket, b: the text's code, flag: whether it asks under it), once a task for equal texts.
    1: counts of a word or shape (a: its hash, b: how often it ends a sentence or text, c: how often it does not).
    2: a text (a: k, b and c: hashes of its closing word and of that word's shape, d: code, e: hash, flag: full stop).
    Codes are in the order of the texts' lengths, with a hash below.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        hashes, bands, h64 = Hashes(), Bands(), lambda w: xxhash.xxh64_intdigest(w) - (1 << 63)
        every: Counter[str] = Counter()
        ends: Counter[str] = Counter()
        met: set[int] = set()

        def frame(kind: int, a, b, c=None, d=None, e=None, flag=None) -> pd.DataFrame:
            zero = np.zeros(len(a), np.int64)
            rest = {n: zero if x is None else x for n, x in zip("cde", (c, d, e))}
            return pd.DataFrame({"kind": kind, "a": a, "b": b, **rest, "flag": zero.astype(bool) if flag is None else flag})

        def banded(group: list[list[bytes]], codes: list[int]) -> tuple[np.ndarray, ...]:
            buckets, place, asks = bands.of(*shingles(group, hashes))
            return buckets.view(np.int64), np.array(codes, np.int64)[place], asks

        def counted() -> pd.DataFrame:
            tally: dict[str, list[int]] = {}
            for w, n in every.items():
                e = ends.get(w, 0)
                for key in (f"w{w}", f"s{shape(w)}"):
                    t = tally.setdefault(key, [0, 0])
                    t[0] += e
                    t[1] += n - e
            every.clear()
            ends.clear()
            return frame(1, np.array([h64(w) for w in tally], np.int64), np.array([t[0] for t in tally.values()], np.int64), np.array([t[1] for t in tally.values()], np.int64))

        for batch in batches:
            found, group, codes, size, closing = [], [], [], 0, []
            for k, t in zip(batch["k"], batch["t"]):
                tokens = t.split()
                if not tokens:
                    continue
                last = tokens[-1]
                ends.update([w for w, x in pairwise(tokens) if w[-1] in _STOPS and x[0] in _NEXT and _TERMINATED.search(w)])
                every.update([m[1] for w in tokens if "." in w and (m := _DECIMAL.match(w))])
                stop = bool(_TERMINATED.search(last))
                if stop:
                    tokens.pop()  # a closing full stop proves nothing
                else:
                    ends[last] += 1
                every.update(tokens)
                digest = xxhash.xxh64_intdigest(t)
                code = min(len(t), (1 << 24) - 1) << 39 | digest >> 25
                closing.append((k, h64(f"w{last}"), h64(f"s{shape(last)}"), code, digest - (1 << 63), stop))
                if digest in met:
                    continue
                if len(met) > 2_000_000:
                    met.clear()
                met.add(digest)
                if w := words(t):
                    group.append(w)
                    codes.append(code)
                    size += len(w)
                if size > GROUP:
                    found.append(banded(group, codes))
                    group, codes, size = [], [], 0
            if group:
                found.append(banded(group, codes))
            if found:
                buckets, coded, asks = map(np.concatenate, zip(*found))
                yield frame(0, buckets, coded, flag=asks)
            if closing:
                *columns, stops = zip(*closing)
                a, b, c, d, e = (np.array(x, np.int64) for x in columns)
                yield frame(2, a, b, c, d, e, np.array(stops, bool))
            if len(every) > 500_000:
                yield counted()
        yield counted()

    return texts.select("k", F.col("body").alias("t")).mapInPandas(scan, "kind int, a long, b long, c long, d long, e long, flag boolean")


def _chain(a: list[str], b: list[str]) -> list[int]:
    """For every word of ``a`` its place in ``b`` (or -1), increasing: the common beginning, runs that hold once-only shingles, and their extensions."""
    at = [-1] * len(a)
    p = 0
    while p < len(a) and p < len(b) and a[p] == b[p]:
        at[p] = p
        p += 1
    if p == len(a):
        return at
    mine, other = _once(a, p), _once(b, p)
    pairs = sorted((i, other[g]) for g, i in mine.items() if g in other)
    # longest increasing run of places, by patience
    tails: list[int] = []
    held: list[tuple[int, int]] = []
    back: list[int] = []
    for n, (i, j) in enumerate(pairs):
        at_pile = bisect_left(tails, j)
        tails[at_pile : at_pile + 1] = [j]
        held[at_pile : at_pile + 1] = [(n, j)]
        back.append(held[at_pile - 1][0] if at_pile else -1)
    n = held[-1][0] if held else -1
    chain = []
    while n >= 0:
        chain.append(pairs[n])
        n = back[n]
    for i, j in reversed(chain):
        for d in range(SHINGLE):
            at[i + d] = j + d
    # runs go on to both sides while the words are the same
    last = p - 1
    for i in range(p, len(a)):
        if at[i] >= 0:
            last = at[i]
        elif i and at[i - 1] >= 0 and at[i - 1] + 1 < len(b) and a[i] == b[at[i - 1] + 1]:
            at[i] = last = at[i - 1] + 1
    for i in range(len(a) - 2, p - 1, -1):
        if at[i] < 0 and at[i + 1] > 0 and a[i] == b[at[i + 1] - 1] and at[i + 1] - 1 > max(at[:i], default=-1):
            at[i] = at[i + 1] - 1
    return at


def _once(x: list[str], start: int) -> dict[tuple[str, ...], int]:
    seen: dict[tuple[str, ...], int] = {}
    for i in range(start, len(x) - SHINGLE + 1):
        g = tuple(x[i : i + SHINGLE])
        seen[g] = -1 if g in seen else i
    return {g: i for g, i in seen.items() if i >= 0}


def _begins(part: str, word: str) -> bool:
    """Whether ``part`` is a word broken off, or the word itself but for its punctuation."""
    bare = part.rstrip(".,;:…")
    return bool(bare) and word.startswith(bare)


def _tail(rest: list[str], follows: list[str]) -> int | None:
    """How many words of ``follows`` the unmatched end ``rest`` takes up, its last word matched and few others changed."""
    if not rest:
        return 0
    row = list(range(len(follows) + 1))
    for i, x in enumerate(rest, 1):
        last, new = i == len(rest), [i]
        for j, y in enumerate(follows, 1):
            same = x == y or (last and _begins(x, y))
            new.append(row[j - 1] if same else min(row[j - 1], row[j], new[-1]) + 1)
            if last and not same:
                new[-1] = len(rest) + len(follows)
        row = new
    cost, j = min((c, j) for j, c in enumerate(row[1:], 1)) if follows else (1, 0)
    return j if cost <= (max(1, len(rest) // 3) if len(rest) > 1 else 0) else None


def align(short: str, long: str) -> str | None:
    """How ``short`` ends against ``long``: None for no near-copy, ``cut``, ``whole``, or ``near`` where that copy does not tell.

    The words of both are aligned in order; the last ones are aligned with single changes allowed, and the very last
    one may be the beginning of a word.
    """
    a, b = short.lower().split(), long.lower().split()
    if len(a) < 4:
        return None
    runs = lambda x: {tuple(x[i : i + SHINGLE]) for i in range(max(1, len(x) - SHINGLE + 1))}
    mine = runs(a)
    if len(a) > 2 * SHINGLE and len(mine & runs(b)) < SIMILARITY * len(mine) - 1:
        return None
    at = _chain(a, b)
    size = min(SHINGLE, len(a))
    n = len(a) - size + 1
    steps = [0, *np.cumsum([x >= 0 and y == x + 1 for x, y in zip(at, at[1:])]).tolist()]
    held = sum(steps[i + size - 1] - steps[i] == size - 1 for i in range(n))
    # A word broken off spoils one shingle, which is none of the other text's.
    if held < SIMILARITY * n - (at[-1] < 0):
        return None
    i = max(i for i, j in enumerate(at) if j >= 0)
    rest, start = a[i + 1 :], at[i] + 1
    if len(rest) > 3 * SHINGLE:
        return "near"
    used = _tail(rest, b[start : start + len(rest) + 3])
    if used is None:
        return "near"
    end = start + used
    word, own = b[end - 1], a[-1]
    if word != own and len(word) > len(own.rstrip(".,;:…")) and word[len(own.rstrip(".,;:…"))].isalnum():
        return "cut"
    if end == len(b):
        return "near"
    return "whole" if _TERMINATED.search(own) and (word == own or _TERMINATED.search(word)) else "cut"


def _near_copies(scanned: DataFrame, texts: DataFrame) -> DataFrame:
    """(k, verdict) of the records that a near-copy decides; texts has (k, body)."""
    bands = scanned.where("kind = 0").select(F.col("a").alias("bucket"), F.col("b").alias("code"), F.col("flag").alias("asks"))
    known = scanned.where("kind = 2").select(F.col("a").alias("k"), F.col("d").alias("code"), F.col("e").alias("hash"))
    reps = known.groupBy("code", "hash").agg(F.min("k").alias("k"))
    shorter = lambda a, b: F.shiftright(a, 39) < F.shiftright(b, 39)
    tops = bands.groupBy("bucket").agg(F.max("code").alias("top"), F.min(F.when(F.col("asks"), F.col("code"))).alias("least")).where(shorter(F.col("least"), F.col("top"))).select("bucket", "top")
    asking = cut(bands.where("asks").select("bucket", "code").join(tops, "bucket").where(shorter(F.col("code"), F.col("top"))))
    verdict = F.pandas_udf(lambda a, b: pd.Series([align(x, y) for x, y in zip(a, b)], dtype=object), "string")

    def judge(pairs: DataFrame) -> DataFrame:
        """(code, hash, verdict) of the texts that one of their pairs (code, other) verifies."""
        side = lambda code, role: reps.select(F.col("code").alias(code), F.col("hash").alias(f"h{role}"), F.col("k").alias(f"k{role}"))
        keyed = cut(pairs.distinct().join(side("code", 0), "code").join(side("other", 1), "other").select("code", "h0", "k0", "k1"))
        # The texts are met once; both of a pair then come together.
        ends = keyed.select("k0", "k1", F.explode(F.array("k0", "k1")).alias("k"))
        both = ends.join(texts, "k").groupBy("k0", "k1").agg(F.max(F.when(F.col("k") == F.col("k0"), F.col("body"))).alias("x"), F.max(F.when(F.col("k") == F.col("k1"), F.col("body"))).alias("y"))
        judged = both.select("k0", verdict("x", "y").alias("verdict")).where("verdict is not null").groupBy("k0").agg(F.min("verdict").alias("verdict"))  # cut before near before whole
        return cut(judged.join(keyed.select("code", "h0", "k0").distinct(), "k0").select("code", F.col("h0").alias("hash"), "verdict"))

    found = done = judge(asking.select("code", F.col("top").alias("other")))
    left = cut(asking.join(found, "code", "left_anti").select("bucket", "code"))
    if left.limit(1).count():
        # The rest goes on down the bucket's different texts, four times as many a round.
        ranked = bands.join(left.select("bucket").distinct(), "bucket", "left_semi").select("bucket", F.col("code").alias("other")).distinct()
        ranked = cut(ranked.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("other")))).where("rank > 1"))
        tried, more = 1, True
        while more:
            longer = left.join(ranked, "bucket").where(shorter(F.col("code"), F.col("other")))
            found = judge(longer.where((F.col("rank") > tried) & (F.col("rank") <= 4 * tried)).select("code", "other"))
            done, tried = done.unionByName(found), 4 * tried
            left = cut(left.join(found, "code", "left_anti"))
            more = left.join(ranked.where(F.col("rank") > tried), "bucket").where(shorter(F.col("code"), F.col("other"))).limit(1).count() > 0
    return known.join(done, ["code", "hash"]).select("k", "verdict")


def truncated(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, cut, reason)`` for every record with a non-blank text.

    ``reason``: ``copy`` (a near-copy runs on), ``marked`` or ``markup`` (its own end shows the cut), ``closing``
    (scored by terminality), or null for an uncut text. ``key`` is a unique number. Null and blank texts give no row;
    equal texts are judged alike; an empty table gives none. Closing notices of publishers are looked behind.
    """
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("raw")).where("k is not null").where(F.col("raw").rlike(r"\S"))
    rows = rows.withColumn("plain", A.plain_text(F.col("raw"))).withColumn("opened", A.opened(F.col("plain")))
    rows = rows.select("k", (F.col("plain") != "").alias("filled"), F.col("opened.sentences").alias("s"), F.col("opened.marked").alias("marked"))
    first = lambda s, n: F.substring_index(s, " ", n)
    sentences = F.transform("s", lambda s: F.struct(first(s, 1).alias("lead1"), first(s, 2).alias("lead2"), F.right(s, F.lit(8)).rlike(TERMINATED).alias("closed")))
    last = F.try_element_at("s", F.lit(-1))
    words = F.when(first(last, 1) == last, 1).when(first(last, 2) == last, 2).otherwise(3)
    rows = rows.select("k", "filled", F.array_join("s", " ").alias("body"), sentences.alias("sentences"), "marked", F.coalesce(last.rlike(BROKEN), F.lit(False)).alias("markup"), last.rlike(CLOSING_FORM).alias("form"), last.rlike(JOINING).alias("joining"), words.alias("words"))
    rows = cut(rows).where("filled")
    texts = rows.where("body <> ''").select("k", F.when(F.col("markup"), F.rtrim(F.regexp_replace("body", BROKEN, ""))).otherwise(F.col("body")).alias("body"))
    scanned = cut(_scan(texts), "kind")
    copies = _near_copies(scanned, texts)

    # How often closing words, and their shapes, end sentences and texts.
    counts = scanned.where("kind = 1").groupBy(F.col("a").alias("hash")).agg(F.sum("b").alias("ends"), F.sum("c").alias("inside"))
    lasts = scanned.where("kind = 2").select(F.col("a").alias("k"), F.col("flag").alias("stop"), F.posexplode(F.array("b", "c")).alias("shape", "hash")).join(counts, "hash", "left")
    pick = lambda kind, c: F.coalesce(F.max(F.when(F.col("shape") == kind, F.col(c))), F.lit(0))
    ends = lasts.groupBy("k").agg(F.max("stop").alias("stop"), pick(0, "ends").alias("e"), pick(0, "inside").alias("i"), pick(1, "ends").alias("es"), pick(1, "inside").alias("is"))
    own = F.when(F.col("stop"), 0).otherwise(1)  # an open end was counted itself
    prior = F.when(F.col("stop"), 1.0).otherwise(0.0)
    estimate = lambda hit, n, before, weight: (hit + weight * before) / (n + weight)
    shaped = estimate(F.col("es") - own, F.col("es") + F.col("is") - own, prior, 2.0)
    ends = ends.select("k", "stop", shaped.alias("shaped"), estimate(F.col("e") - own, F.col("e") + F.col("i") - own, shaped, 2.0).alias("terminal"))

    # How sentences that begin alike end.
    parts = rows.select(F.posexplode("sentences").alias("i", "s"), F.size("sentences").alias("n")).select("s.lead1", "s.lead2", "s.closed", (F.col("i") == F.col("n") - 1).alias("last"))
    by2 = cut(parts.groupBy("lead1", "lead2").agg(F.count_if(F.col("last") & ~F.col("closed")).alias("open2"), F.count_if("closed").alias("closed2")))
    by1 = by2.groupBy("lead1").agg(F.sum("open2").alias("open1"), F.sum("closed2").alias("closed1"))
    judged = rows.select("k", "marked", "markup", "form", "joining", "words", F.try_element_at("sentences", F.lit(-1)).alias("s")).join(ends, "k", "left")
    unsure = judged.where("not stop").select("k", "s.lead1", "s.lead2", "words", "form", F.when(F.col("joining"), 0.0).otherwise(F.col("shaped")).alias("shaped"), F.when(F.col("joining"), 0.0).otherwise(F.col("terminal")).alias("terminal"))
    likely = F.greatest("terminal", F.when(F.col("form"), 0.9).otherwise(0.0))
    s1 = estimate(F.col("open1") - 1, F.col("open1") + F.col("closed1") - 1, likely, PRIOR)
    s2 = estimate(F.col("open2") - 1, F.col("open2") + F.col("closed2") - 1, s1, PRIOR)
    # A word alone may be the beginning of any, so only its shape counts.
    scored = unsure.join(by2, ["lead1", "lead2"]).join(by1, "lead1").select("k", F.when(F.col("words") == 1, F.col("shaped")).when(F.col("words") == 2, s1).otherwise(s2).alias("score"))
    out = judged.select("k", "marked", "markup", "stop", "terminal").join(scored, "k", "left").join(copies, "k", "left")
    broken_off = F.coalesce(F.when(F.col("stop"), F.col("terminal")).otherwise(F.col("score")), F.lit(1.0)) < 0.5
    unsettled = F.coalesce("verdict", F.lit("near")) == "near"
    reason = F.when(F.col("verdict") == "cut", "copy").when(F.col("marked"), "marked").when(F.col("markup"), "markup").when(unsettled & broken_off, "closing")
    return out.select(F.col("k").alias(key), reason.isNotNull().alias("cut"), reason.alias("reason"))
