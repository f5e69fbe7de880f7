"""Tables written between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where that is unset a local master, as in tests, takes a local folder; a cluster has no folder that all its machines see, so that is an error."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set: driver and executors need a shared folder")
    return shared or f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark).rstrip('/')}/spindrel/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df once and reads it back: later jobs start from the files, whatever executors are lost."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def drop(*saved: DataFrame) -> None:
    """Deletes the files of tables that save returned and that no later job reads."""
    for df in saved:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def freed(spark: SparkSession):
    """Shuffle files of each query that is run inside are deleted as it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
