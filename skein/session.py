"""Session helpers: table reading and durable lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: the one the cluster names, else a folder of this process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="skein-")
        atexit.register(shutil.rmtree, _own[app], True)
    return _own[app]


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder, parted by the given columns, and read it back.

    Ends the lineage durably (a lost executor costs no recomputation) and leaves a columnar table, so later
    branches read only their columns. The folder is kept until the session's checkpoint folder is removed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    if path.startswith("file:") or path.startswith("/"):
        atexit.register(shutil.rmtree, path.removeprefix("file://").removeprefix("file:"), True)
    return spark.read.schema(df.schema).parquet(path)
