"""Evaluation texts leaking into training text: an inverted index of the test items, queried by every passage.

The items' words are indexed with BM25 weights, in postings sorted by item and cut into blocks with their maxima. Every
document, and of longer ones every passage, is a query of block-max WAND: the maxima of its words tell which blocks may
hold an item over its threshold, and only in those are the postings walked, from pivot to pivot. Thresholds are the
least scores that a leaked half of an item can have, in all and in the larger of its two passages, so retrieval loses
nothing; an alignment of the words in order then decides, and the answer is looked for behind it. No shuffle of the
corpus, and one scan of it for every ``index_chars`` of items.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import cut

K1, B = 1.2, 0.75
#: Share of a passage's BM25 weight that must be matched: the template of a statement with other terms is no leak.
FIRM = 0.7
_INLINE = re.compile(r"</?(?:i|b|u|em|strong|sub|sup|span|a|mark|small|tt|code|font)\b[^<>]*>", re.IGNORECASE)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_BROKEN = re.compile(r"(?<=\w)[-‐­]\s*[\r\n]+\s*(?=\w)")
_MARKS = re.compile(r"[*_`~­​-‍﻿]+")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Words of a text in lower case; mark-up, entities, typography and broken lines aside."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "\n" in text or "\r" in text:
        text = _BROKEN.sub("", text)
    return _WORD.findall(_MARKS.sub("", text).lower())


def lightest(own: list[str], weight: dict[str, float], size: int) -> float:
    """Least weight of the different words of any ``size`` consecutive ones."""
    count: dict[str, int] = defaultdict(int)
    held, least = 0.0, math.inf
    for i, w in enumerate(own):
        count[w] += 1
        if count[w] == 1:
            held += weight[w]
        if i >= size:
            out = own[i - size]
            count[out] -= 1
            if not count[out]:
                held -= weight[out]
        if i >= size - 1:
            least = min(least, held)
    return least if size else 0.0


class Posting(NamedTuple):
    """A word's items inside one block (by ordinal, ascending), what it weighs in each, and the most of it."""

    items: list[int]
    weights: list[float]
    most: float


class Index:
    """Inverted index of items with block maxima; built in one pass over their words.

    ``df``, ``n`` and ``size``: in how many items each word is, how many items and words there are in all, where the
    index holds only a part of them.
    """

    def __init__(self, items: list[tuple[int, list[str]]], df: dict[str, int] | None = None, n: int | None = None, size: int | None = None, share: float = 0.5, firm: float = FIRM, block: int = 2, steps: int = 32) -> None:
        kept = sorted((i, w) for i, w in items if w)
        self.block, self.ids, self.words = block, [i for i, _ in kept], [w for _, w in kept]
        if df is None:
            df = defaultdict(int)
            for own in self.words:
                for w in set(own):
                    df[w] += 1
        n, size = n or len(kept), size or sum(map(len, self.words))
        self.reach = max(map(len, self.words), default=0)
        self.weight: list[dict[str, float]] = []
        postings: dict[str, tuple[list[int], list[float]]] = defaultdict(lambda: ([], []))
        #: Least score of all that is held of an item, and of its larger passage.
        held, larger = [], []
        for o, own in enumerate(self.words):
            norm, tf = K1 * (1 - B + B * len(own) * n / size), Counter(own)
            weight = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + norm) for w, c in tf.items()}
            self.weight.append(weight)
            half = math.ceil(share * len(own))
            # Least weights grow with the size, so those at a few sizes bound those between them.
            grid = sorted({round(half * x / min(half, steps)) for x in range(min(half, steps) + 1)})
            at = {g: lightest(own, weight, g) for g in {*grid, *[half - g for g in grid], -(-half // 2)}}
            both = min(at[a] + at[half - b] for a, b in zip(grid, [*grid[1:], half])) if half > steps else min(at[a] + at[half - a] for a in grid)
            twice = sum(x for w, x in weight.items() if tf[w] > 1)
            larger.append(firm * at[-(-half // 2)] - 1e-9)
            held.append(max(larger[-1], firm * both - twice - 1e-9))
            for w, x in weight.items():
                postings[w][0].append(o)
                postings[w][1].append(x)
        #: Block maxima of every word, and every block's postings.
        self.maxima: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.blocks: list[dict[str, Posting]] = [{} for _ in range(-(-len(kept) // block))]
        for w, (o, x) in postings.items():
            blocks, first = np.unique(np.array(o) // block, return_index=True)
            self.maxima[w] = blocks, np.maximum.reduceat(np.array(x), first)
            for k, i, j in zip(blocks.tolist(), first, [*first[1:], len(o)]):
                self.blocks[k][w] = Posting(o[i:j], x[i:j], max(x[i:j]))
        self.top = {w: float(most.max()) for w, (_, most) in self.maxima.items()}
        self.thresholds = []
        for least in (held, larger):
            starts = np.arange(0, len(least), block)
            self.thresholds.append((least, np.minimum.reduceat(np.array(least), starts) if least else np.zeros(0), min(least, default=math.inf)))

    def retrieve(self, terms: set[str], level: int) -> list[int]:
        """Items whose score for a query reaches their threshold (0: of all that is held, 1: of the larger passage)."""
        least, block_least, floor = self.thresholds[level]
        if sum(map(self.top.__getitem__, terms)) < floor:
            return []
        lists = [self.maxima[w] for w in terms]
        bound = np.bincount(np.concatenate([k for k, _ in lists]), np.concatenate([x for _, x in lists]), len(block_least))
        found: list[int] = []
        for k in np.flatnonzero(bound >= block_least).tolist():
            found += self._walk(terms, self.blocks[k], least, float(block_least[k]))
        return found

    def _walk(self, terms: set[str], block: dict[str, Posting], least: list[float], floor: float) -> list[int]:
        """WAND inside a block: cursors sorted by item, the pivot is where their maxima reach the floor."""
        cursors = [[p.items[0], 0, p.most, p] for p in map(block.__getitem__, block.keys() & terms)]
        found = []
        while cursors:
            cursors.sort(key=itemgetter(0))
            held, pivot = 0.0, None
            for c in cursors:
                held += c[2]
                if held >= floor:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            moved = False
            if cursors[0][0] == pivot:
                score = 0.0
                for c in cursors:
                    if c[0] != pivot:
                        break
                    score += c[3].weights[c[1]]
                    c[1] += 1
                if score >= least[pivot]:
                    found.append(pivot)
            else:
                for c in cursors:
                    if c[0] >= pivot:
                        break
                    c[1] = bisect_left(c[3].items, pivot, c[1])
            for c in cursors:
                if c[0] > pivot:
                    break
                c[0] = c[3].items[c[1]] if c[1] < len(c[3].items) else -1
                moved = moved or c[0] < 0
            if moved:
                cursors = [c for c in cursors if c[0] >= 0]
        return found

    def candidates(self, text: list[str]) -> set[int]:
        """Items retrieved by the document and by any of its passages, which are twice as long as the longest item and overlap by half."""
        present = self.top.keys() & set(text)
        found = set(self.retrieve(present, 0)) if present else set()
        if not found or len(text) <= 2 * self.reach:
            return found
        least, wanted = self.thresholds[1][0], set()
        floor = min(map(least.__getitem__, found))
        for a in range(0, max(1, len(text) - self.reach), self.reach):
            terms = present.intersection(text[a : a + 2 * self.reach])
            if sum(map(self.top.__getitem__, terms)) < floor:
                continue
            for o in found - wanted:
                if sum(map(self.weight[o].__getitem__, terms & self.weight[o].keys())) >= least[o]:
                    wanted.add(o)
        return wanted


def passages(item: list[str], text: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(item from, item to, text from, text to, words matched) of runs in order, single changed words aside."""
    at: dict[str, list[int]] = defaultdict(list)
    for i, w in enumerate(item):
        at[w].append(i)
    # best run that ends at a pair (text position, item position): (matched, item start, text start)
    runs: dict[tuple[int, int], tuple[int, int, int]] = {}
    extended: set[tuple[int, int]] = set()
    for j, w in enumerate(text):
        for i in at.get(w, ()):
            best, origin = (1, i, j), None
            for dj, di in ((1, 1), (2, 2), (1, 2), (2, 1)):
                r = runs.get((j - dj, i - di))
                if r and r[0] + 1 > best[0]:
                    best, origin = (r[0] + 1, r[1], r[2]), (j - dj, i - di)
            runs[j, i] = best
            if origin:
                extended.add(origin)
    return [(r[1], i + 1, r[2], j + 1, r[0]) for (j, i), r in runs.items() if (j, i) not in extended and r[0] >= 3]


def overlap(item: list[str], text: list[str], weight: dict[str, float], firm: float = FIRM) -> tuple[float, int]:
    """(share, end): the share of the item's words that the text holds, each of one or two passages in order, changed
    words aside, and where in the text the last passage ends."""
    found = []
    for a, b, c, d, matched in passages(item, text):
        held = set(text[c:d])
        total = sum(weight[w] for w in item[a:b])
        if sum(weight[w] for w in item[a:b] if w in held) >= firm * total:
            found.append((b - a, a, b, c, d))
    if not found:
        return 0.0, 0
    found.sort(reverse=True)
    best, end = found[0][0], found[0][4]
    for x, p in enumerate(found):
        if 2 * p[0] <= best:
            break
        for q in found[x + 1 :]:
            first, second = (p, q) if p[1] <= q[1] else (q, p)
            apart = p[4] <= q[3] or q[4] <= p[3]
            both = p[0] + q[0] - max(0, first[2] - second[1])
            if apart and both > best:
                best, end = both, max(p[4], q[4])
    return best / len(item), end


def _follows(answer: list[str], text: list[str], start: int, stop: int) -> bool:
    """Whether the answer's words stand together in text[start:stop]."""
    return bool(answer) and any(text[i : i + len(answer)] == answer for i in range(start, min(stop, len(text)) - len(answer) + 1))


def leaks(docs: DataFrame, items: DataFrame, doc_key: str, doc_text: str, item_key: str, item_text: str, item_answer: str | None = None, share: float = 0.5, index_chars: int = 1 << 25) -> DataFrame:
    """``(doc_key, item_key, overlap, answer_held)`` for documents that hold at least ``share`` of an item's words in order.

    ``overlap``: that share. ``answer_held``: whether the item's answer stands behind the passage, within the length of
    the longest item; it is reported, not required, and false without ``item_answer``. Items are indexed in parts of
    about ``index_chars`` characters, which is what is broadcast at a time; weights come from all of them, so the
    result does not depend on it. Null and empty texts hold nothing and are held nowhere; a repeated document row is
    reported once. Other columns play no part.
    """
    tokens = F.pandas_udf(lambda s: s.map(words), "array<string>")
    answer = F.col(item_answer) if item_answer else F.lit(None)
    chosen = items.select(F.col(item_key).cast("long").alias("k"), F.col(item_text).alias("t"), answer.cast("string").alias("a")).where("k is not null and t is not null").distinct()
    chosen = cut(chosen.select("k", tokens("t").alias("w"), tokens("a").alias("a"), F.char_length("t").alias("chars")).where(F.size("w") > 0))
    n, size, chars = chosen.agg(F.count("*"), F.coalesce(F.sum(F.size("w")), F.lit(0)), F.coalesce(F.sum("chars"), F.lit(0))).first()
    spread = chosen.select("k", F.explode(F.array_distinct("w")).alias("w"))
    counts = spread.groupBy("w").agg(F.count("*").alias("n"))
    slim = docs.select(F.col(doc_key).cast("long").alias("k"), F.col(doc_text).alias("t")).where("k is not null and t is not null")
    out = None
    parts = max(1, -(-chars // index_chars))
    for p in range(parts):
        own = lambda df: df.where(F.pmod(F.xxhash64("k"), F.lit(parts)) == p)  # noqa: B023, E731
        df = {r["w"]: r["n"] for r in counts.join(own(spread).select("w").distinct(), "w", "left_semi").toLocalIterator()}
        rows = own(chosen).select("k", "w", "a").collect()
        index = Index([(r["k"], r["w"]) for r in rows], df, n, size, share)
        shared = docs.sparkSession.sparkContext.broadcast((index, {r["k"]: r["a"] or [] for r in rows}))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index, answers = shared.value
            for batch in batches:
                found = []
                for k, t in zip(batch["k"], batch["t"]):
                    text = words(t)
                    for o in index.candidates(text):
                        part, end = overlap(index.words[o], text, index.weight[o])
                        if part >= share:
                            found.append((k, index.ids[o], part, _follows(answers[index.ids[o]], text, end, end + index.reach)))
                yield pd.DataFrame(found, columns=["k", "i", "o", "h"])

        hits = slim.mapInPandas(scan, "k long, i long, o double, h boolean")
        out = hits if out is None else out.unionByName(hits)
    return out.groupBy(F.col("k").alias(doc_key), F.col("i").alias(item_key)).agg(F.max("o").alias("overlap"), F.max("h").alias("answer_held"))
