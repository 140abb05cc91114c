"""A table written exactly once by a stream that may be stopped and started again.

Every batch is a folder of its own that is overwritten as a whole, so a batch that is
run again after a failure leaves what one run would have left; Spark's checkpoint
says which batch comes next and what is in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from trajspark import shared


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Batches that are written as a whole."""
    names = [n for n in shared.children(spark, path) if n.startswith("batch=")]
    return sorted(int(n.removeprefix("batch=")) for n in names if shared.exists(spark, f"{path}/{n}/_SUCCESS"))


def read_once(spark: SparkSession, path: str, schema: T.StructType, *, before: int | None = None) -> DataFrame:
    """Rows of all whole batches, or of those before one."""
    found = [f"{path}/batch={b}" for b in _batches(spark, path) if before is None or b < before]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def write_once(rows: DataFrame, batch: int, path: str, keys: Sequence[str] = ()) -> None:
    """Write one batch; for use in ``foreachBatch``. With ``keys``, rows whose keys an earlier batch has are left out, and one row of each key stays."""
    if keys:
        rows = rows.dropDuplicates(list(keys)).join(read_once(rows.sparkSession, path, rows.schema, before=batch).select(*keys), list(keys), "left_anti").select(rows.columns)
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def run_to_end(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = ()) -> None:
    """Take in all that the source has by now, from where the last run with this checkpoint ended."""
    query = stream.writeStream.foreachBatch(lambda rows, batch: write_once(rows, batch, path, keys)).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
