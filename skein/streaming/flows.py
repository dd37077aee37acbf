"""Streams: landing folders, evidence kept up to date by batches, and sliding-window admission."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from skein.operators import graph as G
from skein.session import cut
from skein.settings import Settings

_D = Settings()


def landing(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the parquet files that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _path(spark: SparkSession, path: str):
    """(file system, path) of a folder, wherever it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _current(spark: SparkSession, table: str) -> dict[int, int]:
    """The version of each bucket; empty before the first batch. Errors of reading are errors."""
    files, at = _path(spark, f"{table}/current")
    if not files.exists(at):
        return {}
    named = spark.read.schema("bucket int, version long").json(f"{table}/current")
    return {r["bucket"]: r["version"] for r in named.groupBy("bucket").agg(F.max("version").alias("version")).collect()}


def keep_relations(triplets: DataFrame, table: str, checkpoint: str, once: bool = True, buckets: int = 64) -> StreamingQuery:
    """Keep a table of (edge, paper) evidence up to date with a stream of triplets; ``relations`` of it are the edges.

    The table lies in ``buckets`` parts by hash of the edge. A batch writes new versions of the parts that it touches
    beside the old ones and then names them current; parts that two batches have replaced are removed. A batch that
    is run again after a failure finds its evidence already there and changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = _current(spark, table)
        version = max(held.values(), default=0) + 1
        part = F.pmod(F.xxhash64("source", "type", "target"), F.lit(buckets)).cast("int")
        fresh = cut(G.relation_papers(G.insert_rows(batch)).withColumn("bucket", part))
        touched = sorted(r["bucket"] for r in fresh.select("bucket").distinct().collect())
        if not touched:
            return
        old = [f"{table}/v{held[b]}/bucket={b}" for b in touched if b in held]
        merged = fresh.drop("bucket")
        if old:
            merged = G.merge_relation_papers(spark.read.parquet(*old), merged)
        merged.withColumn("bucket", part).write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/v{version}")
        named = spark.createDataFrame([(b, version) for b in touched], "bucket int, version long")
        named.coalesce(1).write.mode("append").json(f"{table}/current")
        for b in touched:
            files, every = _path(spark, f"{table}/v*/bucket={b}")
            for found in files.globStatus(every) or []:
                at = found.getPath()
                if int(at.getParent().getName()[1:]) < held.get(b, 0):  # the version just replaced may still be read
                    files.delete(at, True)

    writer = triplets.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 hour")).start()


def read_relations(spark: SparkSession, table: str) -> DataFrame | None:
    """The current evidence of a table kept by ``keep_relations``; None before the first batch."""
    held = _current(spark, table)
    return spark.read.parquet(*[f"{table}/v{v}/bucket={b}" for b, v in sorted(held.items())]) if held else None


def admit(times: list[float], held: list[float], window: float, limit: int) -> tuple[list[bool], list[float]]:
    """Whether each request, in order, is admitted; rejected ones do not count, and only those older than the window leave."""
    out = []
    for t in times:
        held = [h for h in held if t - h <= window]
        out.append(len(held) < limit)
        if out[-1]:
            held = [*held, t]
    return out, held


def admissions(events: DataFrame, key: str, ts: str, window: float = _D.rate_window, limit: int = _D.rate_limit, order: str | None = None) -> DataFrame:
    """``events`` with ``admitted``, per key in time order.

    Keys are split where a gap longer than the window empties it, so that a hot key's history is folded in parts that
    do not depend on each other. Gaps are looked for in ranges of time, whose ends are all that is compared over a
    key's whole history. Null times are rejected; null keys are one key.
    """
    from pyspark.sql import Window

    at = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    placed = events.withColumn("_key", F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit(""))).withColumn("_at", at).withColumn("_range", F.coalesce(F.floor(at / (256 * window)), F.lit(-(1 << 40))))
    inside = Window.partitionBy("_key", "_range").orderBy(ts, *([order] if order else []))
    ends = placed.groupBy("_key", "_range").agg(F.max("_at").alias("_end"))
    before = Window.partitionBy("_key").orderBy("_range")
    ends = ends.select("_key", "_range", F.lag("_end").over(before).alias("_before"))
    gap = F.col("_at") - F.coalesce(F.lag("_at").over(inside), F.col("_before"))
    runs = placed.join(ends, ["_key", "_range"]).withColumn("_new", F.coalesce((gap > window).cast("int"), F.lit(1)))
    runs = runs.withColumn("_here", F.sum("_new").over(inside))
    earlier = runs.groupBy("_key", "_range").agg(F.sum("_new").alias("n")).select("_key", "_range", F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_past"))
    runs = runs.join(earlier, ["_key", "_range"]).withColumn("_part", F.col("_here") + F.col("_past"))
    names = [f.name for f in events.schema]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[float] = []
        current = None
        for pdf in batches:
            good = []
            for k, part, t in zip(pdf["_key"], pdf["_part"], pdf["_at"]):
                if (k, part) != current:
                    current, held = (k, part), []
                if t != t:  # no time
                    good.append(False)
                    continue
                admitted, held = admit([t], held, window, limit)
                good += admitted
            yield pdf[names].assign(admitted=good)

    # Each task folds many runs one after another, in order; a run is never in two tasks.
    ordered = runs.repartition("_key", "_part").sortWithinPartitions("_key", "_part", "_at", *([order] if order else []))
    return ordered.mapInPandas(fold, StructType(events.schema.fields).add("admitted", "boolean"))


def admission_stream(events: DataFrame, key: str, ts: str, window: float = _D.rate_window, limit: int = _D.rate_limit) -> DataFrame:
    """The same over a stream (key, ts): state per key is the list of admitted times, at most ``limit`` of them."""
    kind = events.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(ts)
        good, held = admit([t.timestamp() for t in rows[ts]], held, window, limit)
        state.update((held,))
        yield pd.DataFrame({key: [k[0]] * len(rows), ts: rows[ts].to_numpy(), "admitted": good})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {ts} timestamp, admitted boolean", "held array<double>", "append", GroupStateTimeout.NoTimeout)


class Versioned:
    """A snapshot that is rebuilt when its source changed or it is older than ``ttl`` seconds."""

    def __init__(self, build: Callable[[], object], version: Callable[[], int], ttl: float = _D.snapshot_ttl, clock: Callable[[], float] | None = None) -> None:
        import time

        self.build, self.version, self.ttl, self.clock = build, version, ttl, clock or time.time
        self.held: tuple[object, int, float] | None = None

    def get(self, force: bool = False) -> object:
        """The snapshot, rebuilt if need be."""
        now, v = self.clock(), self.version()
        if force or self.held is None or self.held[1] != v or now - self.held[2] >= self.ttl:
            self.held = (self.build(), v, now)
        return self.held[0]

    def invalidate(self) -> None:
        """Rebuild at the next call."""
        self.held = None


def backoff(attempt: int, retry_after: float | None = None) -> float:
    """Seconds before the next try of an external call: what the service asks for, else doubling from 2 up to 60."""
    return retry_after if retry_after is not None else min(2.0 * 2**attempt, 60.0)
