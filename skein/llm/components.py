"""Connected components of records that share keys, without pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import cut


def components(links: DataFrame, node: str = "node", key: str = "key") -> DataFrame:
    """Label nodes that share a key, directly or through others, with the smallest node of their component.

    ``links`` has one row per (node, key); nulls link nothing, repeated rows count once. Returns ``(node, component)``
    for every node of a key that has two or more of them; other nodes are components of their own and left out.
    Each key is a hub, so a key of n nodes costs n rows a round, never its pairs, and minima are combined before the
    shuffle. Labels spread over the hubs and then jump to their label's label, which halves the remaining distance;
    a round that changes no label is the last one.
    """
    links = links.select(F.col(node).alias("node"), F.col(key).alias("key")).where(F.col("node").isNotNull() & F.col("key").isNotNull())
    hubs = links.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", F.col("low").alias("label"))
    held = cut(links.join(hubs, "key").select("node", F.xxhash64("key").alias("key"), "label").distinct())
    labels = cut(held.groupBy("node").agg(F.min("label").alias("label")))
    pairs = held.select("node", "key")
    while True:
        seen = pairs.join(labels, "node")
        best = seen.groupBy("key").agg(F.min("label").alias("label"), F.max("label").alias("other"))
        if best.where("label < other").limit(1).count() == 0:
            return labels.select(F.col("node").alias(node), F.col("label").alias("component"))
        spread = pairs.join(best.select("key", "label"), "key").groupBy("node").agg(F.min("label").alias("label"))
        up = spread.select(F.col("node").alias("label"), F.col("label").alias("upper"))
        labels = cut(spread.join(up, "label", "left").select("node", F.least("label", F.coalesce("upper", "label")).alias("label")))
