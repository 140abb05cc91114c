"""A store of fixed-shape samples with a row number each, that can be written on after it was cut off.

Samples are counted first: prefix sums over users and sessions, in natural order, give
every session its first row, so a sample's row is known before any is written and is
the same in every run. Rows lie in parts of a fixed number; a part that is missing
or isn't whole is written again as a whole, the others are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark import shared
from trajspark.functions.scalars import natural_key, one_hot

ROWS_A_PART = 4096
#: Parts written by one job; a job that is cut off leaves none of its parts.
PARTS_A_JOB = 256


def session_rows(samples: DataFrame) -> DataFrame:
    """(user, session, user_idx, first, n): samples of each session and the row of its first.

    Sums run over sessions inside a user and over users, never over samples.
    """
    counts = samples.groupBy("user", "session").agg(F.count("*").alias("n"))
    inside = Window.partitionBy("user").orderBy(natural_key(F.col("session")), "session")
    own = counts.withColumn("_before", F.sum("n").over(inside) - F.col("n"))
    users = counts.groupBy("user").agg(F.sum("n").alias("_m"))
    ordered = Window.orderBy(natural_key(F.col("user")), "user")
    first = users.select("user", (F.row_number().over(ordered) - 1).cast("long").alias("user_idx"), (F.sum("_m").over(ordered) - F.col("_m")).alias("_first"))
    return own.join(first, "user").select("user", "session", "user_idx", (F.col("_first") + F.col("_before")).alias("first"), "n")


def _length(values: Column, kind: T.DataType) -> Column:
    return F.octet_length(values) if isinstance(kind, T.BinaryType) else F.size(values)


def _parts(spark: SparkSession, path: str, total: int, rows_a_part: int) -> list[int]:
    """Parts that are missing or not whole."""
    every = range(-(-total // rows_a_part))
    if not any(n.startswith("part=") for n in shared.children(spark, f"{path}/rows")):
        return list(every)
    held = spark.read.parquet(f"{path}/rows").groupBy("part").agg(F.count_distinct("row").alias("n"), F.count("*").alias("m"), F.min("row").alias("lo"), F.max("row").alias("hi")).collect()
    whole = {r.part for r in held if r.n == r.m == min(rows_a_part, total - r.part * rows_a_part) and r.lo == r.part * rows_a_part and r.hi == r.lo + r.n - 1}
    return [p for p in every if p not in whole]


def write_tensors(samples: DataFrame, path: str, shape: Sequence[int], *, resume: bool = False, rows_a_part: int = ROWS_A_PART, parts_a_job: int = PARTS_A_JOB) -> int:
    """Write (user, session, idx, values, ...) as rows 0, 1, 2, ...; gives how many parts were written.

    values: bytes or an array, ``prod(shape)`` long in every sample, else it is an error.
    A store that is there is refused, or with ``resume`` completed; then the samples
    have to be those that it was begun with.
    """
    spark = samples.sparkSession
    there = shared.exists(spark, f"{path}/index")
    if there and not resume:
        raise ValueError(f"{path} holds a store already; resume it, it is never overwritten")
    if resume and not there:
        raise ValueError(f"{path} holds no store to resume")
    kind = samples.schema["values"].dataType
    wrong = samples.where(~F.coalesce(_length(F.col("values"), kind) == prod(shape), F.lit(False))).count()
    if wrong:
        raise ValueError(f"{wrong} samples aren't of shape {tuple(shape)}")
    about = F.array(*(F.lit(int(s)) for s in shape)).alias("shape"), F.lit(rows_a_part).alias("rows_a_part")
    fresh = session_rows(samples).select("*", *about)
    if there:
        index = spark.read.parquet(f"{path}/index")
        if index.exceptAll(fresh).union(fresh.exceptAll(index)).take(1):
            raise ValueError(f"{path} was begun with other samples, another shape or other parts")
    else:
        index = shared.written(fresh, f"{path}/index")
    total = index.agg(F.sum("n")).first()[0] or 0
    missing = _parts(spark, path, total, rows_a_part)
    place = F.row_number().over(Window.partitionBy("user", "session").orderBy("idx")) - 1
    rows = samples.withColumn("_k", place).join(index.select("user", "session", "user_idx", "first"), ["user", "session"]).withColumn("row", F.col("first") + F.col("_k"))
    rows = rows.drop("_k", "first").withColumn("part", F.expr(f"row div {rows_a_part}"))
    for i in range(0, len(missing), parts_a_job):
        own = missing[i : i + parts_a_job]
        some = rows.where(F.col("part").between(own[0], own[-1]) & F.col("part").isin(own))
        some.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{path}/rows")
    return len(missing)


def read_tensors(spark: SparkSession, path: str) -> DataFrame:
    """(row, user, session, idx, user_idx, label, values, ...) of a whole store; label is one-hot over the users. One that isn't whole is an error."""
    index = spark.read.parquet(f"{path}/index")
    total, users, rows_a_part = index.agg(F.sum("n"), F.max("user_idx") + 1, F.max("rows_a_part")).first()
    if total is None:
        raise ValueError(f"{path} holds no samples")
    if missing := _parts(spark, path, total, rows_a_part):
        raise ValueError(f"{path} lacks {len(missing)} of its parts")
    return spark.read.parquet(f"{path}/rows").drop("part").withColumn("label", one_hot(F.col("user_idx"), users))


def tensor_root(spark: SparkSession, root: str, preferred: Sequence[str] = ()) -> str:
    """The store below a folder: itself, else the first of the preferred names that is one, else the first in order of names."""
    is_store = lambda p: shared.exists(spark, f"{p}/index")
    if is_store(root):
        return root
    names = shared.children(spark, root)
    for name in [*(p for p in preferred if p in names), *names]:
        if is_store(f"{root}/{name}"):
            return f"{root}/{name}"
    raise ValueError(f"no store in {root}")
