"""Tables shared by all executors: cut lineage by writing and rereading Parquet.

Blocks are kept per context, so queries that are built in several threads don't delete each other's tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from trajspark.shared import delete, new_path, shared_dir

__all__ = ["delete", "new_path", "shared_dir", "temporary", "write_out"]

_open: ContextVar[tuple[list[tuple[DataFrame, str]], ...]] = ContextVar("tables written inside blocks", default=())


def write_out(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to a fresh shared table and read it back with its schema."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _open.get():
        _open.get()[-1].append((out, path))
    return out


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables written inside are deleted at the end, except those put into the list that this gives.

    What leaves the block must depend on kept tables (and inputs) alone.
    """
    kept: list[DataFrame] = []
    written: list[tuple[DataFrame, str]] = []
    outer = _open.get()
    _open.set((*outer, written))
    try:
        yield kept
    finally:
        _open.set(outer)
        for df, path in written:
            if not any(df is k for k in kept):
                delete(spark, path)
            elif outer:
                outer[-1].append((df, path))

