"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of this session's intermediate tables, for release.
_folders: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share.

    Where that is unset, a session whose executors are threads of this process
    (master local) gets a temporary folder; on a cluster it is an error, as
    executors don't see each other's disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="deltaweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    _folders.append(f"{base.rstrip('/')}/deltaweave-{uuid.uuid4().hex}")
    return _folders[-1]


def release(spark: SparkSession) -> int:
    """Deletes all intermediate tables written so far, and gives their number. What was derived from them can't be read any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    n = 0
    while _folders:
        path = jvm.org.apache.hadoop.fs.Path(_folders.pop())
        n += path.getFileSystem(conf).delete(path, True)
    return n


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """df written once to the shared folder and read again: lineage is cut and nothing is computed twice."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
