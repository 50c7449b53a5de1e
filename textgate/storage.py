"""Intermediates that are written once to the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only in local mode, where it may be unset, a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="textgate-"))
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table that later steps read instead of computing it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/textgate/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def discarded(*frames: DataFrame | None) -> None:
    """Removes tables of ``written`` that no later step reads any more; all else is left alone."""
    for df in frames:
        if path := getattr(df, "written_to", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            df.written_to = None


def located(spark: SparkSession, path: str) -> str:
    """The whole address of a path, which tasks open by ``opened``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return str(at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString())


def opened(where: str) -> tuple[fs.FileSystem, str]:
    """The store of an address, without Spark, and the path in it."""
    local = re.match("file:/+", where)
    return fs.FileSystem.from_uri(f"file:///{where[local.end() :]}" if local else where)
