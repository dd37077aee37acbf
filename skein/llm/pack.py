"""Filling fixed-capacity containers with items: hierarchical residual packing.

Sizes are shuffled to partitions, each partition packs its items best-fit in descending order, nearly full bins are
final, and the underfull ones become the items of the next round, in at most half as many partitions. Best fit leaves
at most one bin a partition that is no more than half full, and only such a bin can still be merged; so the next round
takes these and of the others as many of every fill as could be needed, until none is left that fits into another.
Only numbers are packed; an item's container is found by joining the rounds.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.session import cut

_SPACES = re.compile(r" \s")
#: Fixed value: the pattern that splits a text before byte pairs are merged, as published with the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class _Counts(dict):
    """Token counts of text chunks, filled on demand; chunks end where the tokenizer also starts anew."""

    def __init__(self, encoding, most: int = 2_000_000) -> None:
        self.encode, self.most = encoding.encode_ordinary, most

    def __missing__(self, chunk: str) -> int:
        if len(self) >= self.most:
            self.clear()
        n = self[chunk] = len(self.encode(chunk))
        return n

    def of(self, text: str) -> int:
        # A single space between other characters starts a new pre-token; runs of white space are left to the tokenizer.
        if _SPACES.search(text) or len(text) < 2:
            return len(self.encode(text))
        first, *rest = text.split(" ")
        return (self[first] if first else 0) + sum(map(self.__getitem__, [" " + w for w in rest])) if rest else self[first]


def load_encoding(path: str):
    """A byte-level BPE tokenizer from a file of base64 tokens and ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, tokenizer: str) -> Column:
    """Tokens of ``text`` under the tokenizer at this path (on every executor); null for null, 0 for an empty text."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = _Counts(load_encoding(tokenizer))
        for batch in batches:
            yield batch.map(lambda t: None if t is None else counts.of(t)).astype("Int32")

    return count(text)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin of every item and fill of every bin, by best fit in descending order; sizes are 1 to ``capacity``."""
    order = np.argsort(-sizes, kind="stable")
    bins, fill, open_at, mask = np.empty(len(sizes), np.int64), [], [[] for _ in range(capacity + 1)], 0
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = open_at[room].pop()
            if not open_at[room]:
                mask &= ~(1 << room)
            fill[b] += size
        else:
            b, room = len(fill), capacity
            fill.append(size)
        bins[i] = b
        if left := room - size:
            open_at[left].append(b)
            mask |= 1 << left
    return bins, np.asarray(fill, np.int64)


def _round(items: DataFrame, capacity: int, parts: int, full: float, level: int) -> DataFrame:
    """(item, bin, fill, done): one round of local packing."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        got = list(batches)
        if not got or not sum(map(len, got)):
            return
        rows = pd.concat(got).sort_values(["size", "item"], ascending=[False, True], kind="stable")
        bins, fill = best_fit(rows["size"].to_numpy(), capacity)
        base = (level << 56) + (TaskContext.get().partitionId() << 32)
        yield pd.DataFrame({"item": rows["item"].to_numpy(), "bin": base + bins, "fill": fill[bins], "done": fill[bins] >= full * capacity})

    return items.repartition(parts, F.xxhash64("item")).mapInPandas(pack, "item long, bin long, fill long, done boolean")


def fill_containers(df: DataFrame, key: str, size: str, capacity: int = 2048, full: float = 0.995, per_task: int = 250_000) -> DataFrame:
    """``(key, part, container, from_unit, to_unit, fill)``: the container of every item, never splitting one that fits.

    ``key`` must be a unique number. An item over ``capacity`` is cut: all but its last part fill containers of their
    own, the last part is packed like an item. A size of 0 takes one unit, so that a container's members stay bounded;
    null sizes and keys give no row. An empty table gives none. Every task of the first round packs about ``per_task``
    numbers; a later round has at most 4 * ``capacity`` of them for every task of the one before.
    """
    items = df.select(F.col(key).cast("long").alias("_k"), F.col(size).cast("long").alias("_n")).where("_k is not null and _n is not null").withColumn("_n", F.greatest("_n", F.lit(1)))
    last = F.expr(f"cast((_n - 1) div {capacity} as int)")
    parts = items.select("_k", "_n", F.explode(F.sequence(F.lit(0), last)).alias("_p"), last.alias("_l"))
    parts = parts.select("_k", F.col("_p").alias("part"), (F.col("_p").cast("long") * capacity).alias("a"), F.least(F.col("_n"), (F.col("_p").cast("long") + 1) * capacity).alias("b"), "_l")
    parts = cut(parts.withColumn("item", F.when(F.col("part") == F.col("_l"), F.col("_k"))))
    level = parts.where("item is not null").select("item", (F.col("b") - F.col("a")).alias("size"))
    count, steps = level.count(), []
    tasks = math.ceil(count / per_task)
    while count:
        step = cut(_round(level, capacity, tasks, full, len(steps) + 1))
        steps.append(step)
        if tasks == 1:
            break
        bins = cut(step.where("not done").groupBy(F.col("bin").alias("item")).agg(F.max("fill").alias("size")))
        halves = bins.where(2 * F.col("size") <= capacity)
        small, least = halves.agg(F.count("*"), F.min("size")).first()
        if not small or bins.where(F.col("size") <= capacity - least).limit(2).count() < 2:
            break
        # Bins of one fill are interchangeable; four times the number of small ones is drawn of each (at most ``capacity`` fills).
        room = bins.where((2 * F.col("size") > capacity) & (F.col("size") <= capacity - least))
        often = room.groupBy("size").agg(F.count("*").alias("n"))
        drawn = room.join(F.broadcast(often), "size").where(F.pmod(F.xxhash64("item"), F.col("n")) < 4 * small)
        level = cut(halves.select("item", "size").unionByName(drawn.select("item", "size")))
        count = level.count()
        tasks = max(1, min(math.ceil(count / per_task), tasks // 2))
    if not steps:
        placed = parts.select("item", F.lit(None).cast("long").alias("bin"), F.lit(None).cast("long").alias("fill")).where("item is not null")
    else:
        placed = steps[0].select("item", "bin", "fill")
        for step in steps[1:]:
            up = step.select(F.col("item").alias("bin"), F.col("bin").alias("_b"), F.col("fill").alias("_f"))
            placed = placed.join(up, "bin", "left").select("item", F.coalesce("_b", "bin").alias("bin"), F.coalesce("_f", "fill").alias("fill"))
    out = parts.join(placed, "item", "left")
    alone = F.concat(F.lit("x"), F.col("_k").cast("string"), F.lit("."), F.col("part").cast("string"))
    return out.select(
        F.col("_k").alias(key), (F.col("part") + 1).alias("part"), F.coalesce(F.concat(F.lit("b"), F.col("bin").cast("string")), alone).alias("container"),
        F.col("a").alias("from_unit"), F.col("b").alias("to_unit"), F.coalesce(F.col("fill"), F.col("b") - F.col("a")).alias("fill"),
    )
