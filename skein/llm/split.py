"""Splitting texts at natural boundaries: structure-tree packing.

A text is parsed into a tree (sections by heading level, blocks, then rows, items or sentences, then words). A node
that fits is kept whole; only oversized nodes are opened, and what comes out of neighbours is merged again up to the
limit. Each text is handled alone, so the operator is one scan without a shuffle; only texts over the limit reach
Python, which returns offsets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+")
SENTENCE = re.compile(r".+?(?:[.!?;:][\"')\]]*(?=\s)\s+|$)", re.DOTALL)
WORD = re.compile(r"\S+\s*|\s+")
ATX = re.compile(r"\s{0,3}(#{1,6})\s+\S")
NUMBERED = re.compile(r"\s{0,3}(\d+(?:\.\d+)*)\.?\s+[A-Z][^.!?]{0,70}$")
PLAIN_HEADING = re.compile(r"\s{0,3}(?:[A-Z][A-Za-z&,\- ]{1,60}:?|[A-Z][A-Z0-9 &,\-]{2,60})$")
UNDERLINE = re.compile(r"\s{0,3}(?:={3,}|-{3,})\s*$")
FENCE = re.compile(r"\s{0,3}(```|~~~)")
ITEM = re.compile(r"\s*(?:[-*+•]|\d+[.)]|\[\d+\])\s+\S")
ROW = re.compile(r"\s*\|")

Span = tuple[int, int]


def _lines(text: str, a: int, b: int) -> list[Span]:
    return [m.span() for m in LINE.finditer(text, a, b)]


def _level(text: str, lines: list[Span], i: int) -> int:
    """Heading level of line ``i``, 0 for none."""
    line = text[slice(*lines[i])].rstrip()
    if not line.strip():
        return 0
    if m := ATX.match(line):
        return len(m[1])
    if len(line) > 90:
        return 0
    if i + 1 < len(lines) and UNDERLINE.match(text[slice(*lines[i + 1])]) and not ROW.match(line):
        return 1 if "=" in text[slice(*lines[i + 1])] else 2
    if m := NUMBERED.match(line):
        return 2 + m[1].count(".")
    return 3 if PLAIN_HEADING.match(line) and len(line.split()) <= 6 else 0


def _blocks(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, level, start, end) of headings and blocks; they tile the text."""
    lines, out, i = _lines(text, 0, len(text)), [], 0
    kind_of = lambda s: "row" if ROW.match(s) else "item" if ITEM.match(s) else "text"
    while i < len(lines):
        a, line = lines[i][0], text[slice(*lines[i])]
        j = i + 1
        if m := FENCE.match(line):
            while j < len(lines) and not text[slice(*lines[j])].lstrip().startswith(m[1]):
                j += 1
            kind, level, j = "code", 0, min(j + 1, len(lines))
        elif level := _level(text, lines, i):
            kind = "heading"
            if j < len(lines) and UNDERLINE.match(text[slice(*lines[j])]):
                j += 1
        else:
            kind = kind_of(line)
            while j < len(lines):
                s = text[slice(*lines[j])]
                if not s.strip() or FENCE.match(s) or _level(text, lines, j) or (k := kind_of(s)) != kind and (kind != "item" or k == "row"):
                    break
                j += 1
        while j < len(lines) and not text[slice(*lines[j])].strip():
            j += 1
        out.append((kind, level, a, lines[j - 1][1]))
        i = j
    return out


def _atoms(text: str, kind: str, a: int, b: int) -> list[Span]:
    """Parts of an oversized block: rows, items or code lines, else sentences."""
    if kind in ("row", "code"):
        return _lines(text, a, b)
    if kind == "item":
        spans: list[Span] = []
        for x, y in _lines(text, a, b):
            if spans and not ITEM.match(text[x:y]):
                spans[-1] = (spans[-1][0], y)
            else:
                spans.append((x, y))
        return spans
    return [m.span() for m in SENTENCE.finditer(text, a, b)]


def _merge(spans: list[Span], cap: int) -> list[Span]:
    out: list[Span] = []
    for a, b in spans:
        if out and b - out[-1][0] <= cap:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _open(text: str, a: int, b: int, kinds: tuple[str, ...], cap: int) -> list[Span]:
    """Spans of at most ``cap`` that tile an oversized block, cut as coarsely as possible."""
    if b - a <= cap:
        return [(a, b)]
    if not kinds:
        return [(x, min(x + cap, b)) for x in range(a, b, cap)]
    kind, rest = kinds[0], kinds[1:]
    parts = [m.span() for m in WORD.finditer(text, a, b)] if kind == "word" else _atoms(text, kind, a, b)
    return _merge([s for x, y in parts for s in _open(text, x, y, rest, cap)], cap)


def _pack(text: str, nodes: list[tuple[str, int, int, int]], cap: int) -> list[Span]:
    """Sibling subtrees of a run of nodes, merged bottom-up; the run starts with its heading, if it has one."""
    if not nodes:
        return []
    if nodes[-1][3] - nodes[0][2] <= cap:
        return [(nodes[0][2], nodes[-1][3])]
    if len(nodes) == 1:
        kind, _, a, b = nodes[0]
        return _open(text, a, b, {"text": ("text", "word"), "heading": ("text", "word")}.get(kind, (kind, "text", "word")), cap)
    levels = [n[1] for n in nodes if n[0] == "heading"]
    groups: list[list[tuple[str, int, int, int]]] = []
    own = nodes[0][0] == "heading" and levels and nodes[0][1] <= min(levels)
    inner = [n[1] for n in nodes[1:] if n[0] == "heading"] if own else levels
    top = min(inner, default=0)
    for k, n in enumerate(nodes):
        if not groups or (n[0] == "heading" and n[1] == top and not (own and k == 0)) or not top:
            groups.append([n])
        else:
            groups[-1].append(n)
    if len(groups) > 1 and own and len(groups[0]) == 1:  # a heading directly over a heading
        first = groups[1][0]
        groups = [[(first[0], first[1], nodes[0][2], first[3]), *groups[1][1:]], *groups[2:]]
        if len(groups) == 1:
            return _pack(text, groups[0], cap)
    if len(groups) == 1:  # one heading over all; it opens its first block and is not left alone at a piece's end
        head, first = nodes[0], nodes[1]
        if first[0] == "heading":
            return _merge([(head[2], head[3]), *_pack(text, nodes[1:], cap)], cap)
        return _pack(text, [(first[0], 0, head[2], first[3]), *nodes[2:]], cap)
    return _merge([s for g in groups for s in _pack(text, g, cap)], cap)


def pieces(text: str, limit: int = 2500, overlap: int = 250) -> list[Span]:
    """Spans of at most ``limit`` characters that cover ``text``; neighbours overlap by up to ``overlap``."""
    if len(text) <= limit:
        return [(0, len(text))]
    core = _pack(text, _blocks(text), limit - overlap)
    out = [core[0]]
    for a, b in core[1:]:
        low = max(a - overlap, out[-1][0] + 1)
        back = text[low:a]
        starts = [m.end() for m in re.finditer(r"(?<=[.!?])\s+|\n+", back)] or [m.end() for m in re.finditer(r"\s+", back)]
        starts = [s for s in starts if s < len(back)]
        out.append((low + starts[0] if starts else (low if back and not back.isspace() else a), b))
    return out


def split_texts(df: DataFrame, column: str, limit: int = 2500, overlap: int = 250) -> DataFrame:
    """One row per piece of every text longer than ``limit``: ``piece`` (from 1), ``from_char``, ``to_char``, ``piece_text``.

    Lengths and offsets count code points. Other columns are kept; of those named like the new ones the new ones win.
    Null, empty and shorter texts need no split and give no row; repeated rows are split alike. ``overlap`` must be
    less than ``limit``.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")

    @F.pandas_udf("array<struct<a:int,b:int>>")
    def spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: [{"a": a, "b": b} for a, b in pieces(t, limit, overlap)])

    new = ("piece", "from_char", "to_char", "piece_text")
    keep = [F.col(f"`{c}`") for c in df.columns if c not in new]
    text = F.col(f"`{column}`")
    long = df.where(F.char_length(text) > limit).withColumn("_skein_spans", spans(text))
    rows = long.select("*", F.posexplode("_skein_spans").alias("_skein_i", "_skein_s"))
    a, b = F.col("_skein_s.a"), F.col("_skein_s.b")
    return rows.select(*keep, (F.col("_skein_i") + 1).alias("piece"), a.cast("bigint").alias("from_char"), b.cast("bigint").alias("to_char"), F.substring(text, a + 1, b - a).alias("piece_text"))
