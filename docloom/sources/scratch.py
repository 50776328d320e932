"""Intermediate results in the shared folder of spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's shared folder; only in local mode is one chosen where the session names none."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="docloom-"))
    return sc.getCheckpointDir()


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder.  What is there goes when the application ends."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def settled(df: DataFrame) -> DataFrame:
    """df written once as Parquet and read back."""
    path = f"{fresh(df.sparkSession, 'step')}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
