"""Make this package importable in Python workers."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
#: Large buffers go back to the system when freed, so a worker that is used again holds no more than its task does.
MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(1 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Rows of a batch that goes to Python, where the session keeps Spark's default of 10,000: whole texts come in rows of any length.
BATCH, DEFAULT_ROWS, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"


def share_path(spark: SparkSession) -> None:
    """Put the folder of this package on the workers' PYTHONPATH (a no-op where it is installed), and bound their memory."""
    if spark.conf.get(BATCH) == DEFAULT_ROWS:
        spark.conf.set(BATCH, ROWS)
    env = spark.sparkContext.environment
    for name, value in MEMORY.items():
        env.setdefault(name, value)
    held = env.get("PYTHONPATH", "")
    if ROOT not in held.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, held]))


def with_workers(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, *args, **kwargs) -> DataFrame:
        share_path(spark)
        return query(spark, *args, **kwargs)

    return run
