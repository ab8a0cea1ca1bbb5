"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Without one, a temporary folder, if driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="lodestone-"))
    return _OWN[0]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one; it goes when the session ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None:
        return
    p = context._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """df, written as Parquet and read again: its plan is a scan of known size from here on."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
