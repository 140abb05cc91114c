"""The folder that the driver and all executors share, and tables in it."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: Used only where a local session names no shared folder, as in tests.
LOCAL_FALLBACK = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = LOCAL_FALLBACK
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/trajspark/{name}-{uuid.uuid4().hex}"


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    target, fs = _file(spark, path)
    fs.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _file(spark, path)
    return fs.exists(target)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    target, fs = _file(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def written(df: DataFrame, path: str) -> DataFrame:
    """The table written to ``path`` and read back: what depends on it doesn't compute it again."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, by: Sequence[str], rows: int) -> DataFrame:
    """The rows dealt by their keys to so many partitions that one has about ``rows`` of them.

    Partitions whose size follows from compressed bytes grow with the table before they
    multiply; what a task sorts or explodes doesn't compress. df is counted first.
    """
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(n, *by)
