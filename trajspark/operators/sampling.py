"""Samples of exact size: the rows of least hash, found from counts, without a sort of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of hashes that rows are counted in; the one that holds the limit is ranked row by row.
_RANGES = 4096
_BITS = 60


def hash_of(key: Sequence[str], seed: int) -> Column:
    """A number of 60 bits from the columns' text."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key))
    return F.conv(F.substring(F.md5(text), 1, _BITS // 4), 16, 10).cast("long")


def least_hash(df: DataFrame, rows: int | Column, key: Sequence[str], by: Sequence[str] = (), *, seed: int = 42) -> DataFrame:
    """Add is_in: true for exactly ``rows`` rows (or all, if fewer) of each group of ``by``, those of least hash of ``key``.

    rows: a number, or an expression of _n, the group's rows. The same rows in every
    partitioning and run; rows of equal key are told apart by their other columns,
    equal rows are alike.
    """
    by = list(by)
    hashed = df.withColumn("_h", hash_of(key, seed)).withColumn("_r", F.shiftright("_h", _BITS - _RANGES.bit_length() + 1))
    counts = hashed.groupBy(*by, "_r").agg(F.count("*").alias("_m"))
    whole = Window.partitionBy(*by)
    upto = counts.withColumns({"_before": F.sum("_m").over(whole.orderBy("_r")) - F.col("_m"), "_n": F.sum("_m").over(whole)})
    limit = (F.lit(rows) if isinstance(rows, int) else rows).cast("long")
    # of each range of hashes: how many of its rows are in
    share = upto.select(*by, "_r", F.greatest(F.lit(0), F.least(F.col("_m"), limit - F.col("_before"))).cast("long").alias("_in"), "_m")
    dealt = hashed.join(F.broadcast(share) if not by else share, [*by, "_r"])
    parted = F.when((F.col("_in") > 0) & (F.col("_in") < F.col("_m")), F.struct(*(F.col(c) for c in (*by, "_r"))))
    rank = F.row_number().over(Window.partitionBy(parted).orderBy("_h", *key, *(c for c in df.columns if c not in key)))
    sure = dealt.where("_in = 0 OR _in = _m").withColumn("is_in", F.col("_in") > 0)
    some = dealt.where("_in > 0 AND _in < _m").withColumn("is_in", rank <= F.col("_in"))
    return sure.select(*df.columns, "is_in").union(some.select(*df.columns, "is_in"))


def subsample(df: DataFrame, rows: int, key: Sequence[str], *, seed: int = 42) -> DataFrame:
    """Exactly ``rows`` rows without replacement (all, if there are fewer)."""
    return least_hash(df, rows, key, seed=seed).where("is_in").drop("is_in")


def stratified(df: DataFrame, key: Sequence[str], label: str = "label", share: float = 0.8, *, seed: int = 42) -> DataFrame:
    """Add is_train: true for the floor of ``share`` of each class's rows."""
    return least_hash(df, F.floor(share * F.col("_n")), key, [label], seed=seed).withColumnRenamed("is_in", "is_train")
