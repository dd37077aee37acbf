"""Long exact spans shared between records, as paths of a sampled de Bruijn graph.

Nodes are k-mers of characters sampled by their minimum in every window of the span length, so the same stretch of
text yields the same nodes in every document; an edge is the stretch that holds all span-long windows of one node and
is known by its hash. Only nodes that stand in two documents are kept. An edge that stands in two documents is shared
as a whole; consecutive ones of a document compact into its shared runs. Where paths branch (a node is shared, its
edge is not) the edge's windows are compared one by one, each distinct edge of the node once. All comparisons are
joins on hashes of content with the source coordinates kept; no pair of documents is ever formed, so a span in a
third of all documents costs each of them the same as a span in two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.session import cut

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POS_BITS = np.uint64(28)
_POS_MASK = np.uint64((1 << 28) - 1)
#: Documents are looked up again through this many hash buckets, a bound on what is broadcast.
BUCKETS = 1 << 17
_power = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power[0]) < n:
        size = max(n, 2 * len(_power[0]))
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _power[k] = np.multiply.accumulate(p)
    return _power[0][:n], _power[1][:n]


class Hashed:
    """Prefix hashes of a text, from which the hash of any stretch follows."""

    def __init__(self, text: str) -> None:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.n = len(codes)
        up, self.down = _powers(self.n + 1)
        x = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(x * up[: self.n], out=self.sums[1:], dtype=np.uint64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of text[a:b] for arrays of bounds."""
        h = (self.sums[b] - self.sums[a]) * self.down[a]
        h ^= (b - a).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h

    def windows(self, size: int, a: int = 0, b: int | None = None) -> np.ndarray:
        """Hashes of text[s : s + size] for s from ``a`` below ``b``."""
        s = np.arange(a, self.n - size + 1 if b is None else b)
        return self.of(s, s + size)


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every run of ``size`` values."""
    n = len(x)
    padded = np.full(-(-n // size) * size, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, size)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - size + 1], before[size - 1 : n])


def edges(text: Hashed, span: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, edge, first window, last window) of a text of at least ``span`` characters."""
    if text.n > int(_POS_MASK):
        raise ValueError(f"a text of {text.n} characters is longer than positions can say")
    grams = text.windows(k)
    keyed = (grams & ~_POS_MASK) | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_min(keyed, span - k + 1) & _POS_MASK).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:] - 1, len(at) - 1]
    return grams[at[first]], text.of(first, last + span), first, last


def _frames(parts: Iterator[tuple[np.ndarray, ...]], names: tuple[str, ...], rows: int = 50_000) -> Iterator[pd.DataFrame]:
    """Arrays put together to frames of about ``rows`` rows."""
    held: list[tuple[np.ndarray, ...]] = []
    count = 0
    for p in parts:
        held.append(p)
        count += len(p[0])
        if count >= rows:
            yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*held)))))
            held, count = [], 0
    if held:
        yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*held)))))


def shared_runs(df: DataFrame, key: str, text: str, span: int = 320, k: int = 160) -> DataFrame:
    """``(key, from_char, to_char)``: maximal runs of characters in spans of ``span`` or more shared with another key.

    Offsets count code points from 0, ``to_char`` is exclusive. A span that only repeats within one document is not
    shared. Null, empty and shorter texts have no runs; rows that repeat a key count as one document. An empty table
    gives none. ``k`` only weighs the number of nodes against the number of windows compared, not the result.
    """
    if not 0 < k <= span:
        raise ValueError("k must be from 1 to span")
    docs = df.select(F.col(key).cast("long").alias("d"), F.col(text).alias("t")).where(F.col("d").isNotNull() & (F.char_length("t") >= span))

    def graph(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found() -> Iterator[tuple[np.ndarray, ...]]:
            for batch in batches:
                for d, t in zip(batch["d"], batch["t"]):
                    node, edge, a, b = edges(Hashed(t), span, k)
                    yield np.full(len(a), d, np.int64), node.view(np.int64), edge.view(np.int64), a.astype(np.int32), b.astype(np.int32)

        with np.errstate(over="ignore"):
            yield from _frames(found(), ("d", "node", "edge", "a", "b"))

    rows = docs.mapInPandas(graph, "d long, node long, edge long, a int, b int")
    rows = cut(rows)
    nodes = rows.groupBy("node").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo < hi").select("node")
    kept = cut(rows.join(nodes, "node", "left_semi"))
    state = kept.groupBy("node", "edge").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.min(F.struct("d", "a", "b")).alias("one"))
    state = cut(state.select("node", "edge", (F.col("lo") < F.col("hi")).alias("shared"), "one"))
    whole = kept.join(state.where("shared").select("node", "edge"), ["node", "edge"], "left_semi").select("d", F.col("a").alias("x"), (F.col("b") + span).alias("y"))
    branching = state.where("not shared").select("node").distinct()
    # Of a shared edge one occurrence stands for all; an unshared one may repeat within its document.
    compare = kept.join(state.where("not shared").select("node", "edge"), ["node", "edge"], "left_semi").select("d", "a", "b", F.lit(False).alias("many"))
    stands = state.where("shared").join(branching, "node", "left_semi").select("one.d", "one.a", "one.b", F.lit(True).alias("many"))
    compare = cut(compare.unionByName(stands).groupBy("d").agg(F.collect_list(F.struct("a", "b", "many")).alias("parts")))

    buckets = compare.select(F.pmod(F.xxhash64("d"), F.lit(BUCKETS)).cast("int").alias("bucket")).distinct()
    again = docs.withColumn("bucket", F.pmod(F.xxhash64("d"), F.lit(BUCKETS)).cast("int")).join(F.broadcast(buckets), "bucket", "left_semi").drop("bucket")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found() -> Iterator[tuple[np.ndarray, ...]]:
            for batch in batches:
                for d, t, parts in zip(batch["d"], batch["t"], batch["parts"]):
                    text = Hashed(t)
                    for p in parts:
                        h = text.windows(span, p["a"], p["b"] + 1)
                        yield np.full(len(h), d, np.int64), h.view(np.int64), np.arange(p["a"], p["b"] + 1, dtype=np.int32), np.full(len(h), p["many"])

        with np.errstate(over="ignore"):
            yield from _frames(found(), ("d", "w", "x", "many"))

    windows = cut(again.join(compare, "d").select("d", "t", "parts").mapInPandas(compared, "d long, w long, x int, many boolean"))
    # A window of a shared edge stands in two documents, so at least one of them is another one.
    common = windows.groupBy("w").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.max("many").alias("many")).where("lo < hi or many").select("w")
    single = windows.where("not many").join(common, "w", "left_semi").select("d", "x", (F.col("x") + span).alias("y"))
    order = Window.partitionBy("d").orderBy("x", "y")
    reach = F.max("y").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = whole.unionByName(single).withColumn("start", (F.col("x") > F.coalesce(reach, F.lit(-1))).cast("int"))
    runs = runs.withColumn("run", F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("d", "run").agg(F.min("x").cast("long").alias("from_char"), F.max("y").cast("long").alias("to_char")).select(F.col("d").alias(key), "from_char", "to_char")
