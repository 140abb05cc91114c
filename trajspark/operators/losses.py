"""Loss values and sampling for training sets, as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions.scalars import sigmoid

TINY = 1e-6


def class_priors(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, positive, negative): shares of the labels, at least 1e-6."""
    share = F.avg(F.col("label").cast("double"))
    return df.groupBy(*by).agg(F.greatest(share, F.lit(TINY)).alias("positive"), F.greatest(1 - share, F.lit(TINY)).alias("negative"))


def weighted_bce(df: DataFrame, by: Sequence[str] = (), c_pos: float = 1.0, c_neg: float = 1.0) -> DataFrame:
    """(by, loss): mean cross-entropy of probabilities (score), classes weighed by the inverse of their shares."""
    priors = class_priors(df, by)
    joined = df.join(priors, list(by)) if by else df.crossJoin(F.broadcast(priors))
    y, p = F.col("label").cast("double"), F.col("score")
    loss = -(c_pos / F.col("positive") * y * F.log(p + TINY) + c_neg / F.col("negative") * (1 - y) * F.log(1 - p + TINY))
    return joined.groupBy(*by).agg(F.avg(loss).alias("loss"))


def harmonised_bce(df: DataFrame, by: Sequence[str], delta: float = 0.1) -> DataFrame:
    """(by, loss, plain): cross-entropy of logits, weighed by the inverse density of gradient sizes |sigmoid(logit) - label|.

    The density of a row is the number of rows of its group within delta, over
    delta: a range frame, so no pairs are made. Losses come from the logits, so
    certain ones have finite losses. A group is one window's frame: groups are batches.
    """
    y, z = F.col("label").cast("double"), F.col("logit")
    keys = ", ".join(f"`{k}`" for k in by)
    near = F.expr(f"count(*) OVER (PARTITION BY {keys} ORDER BY _g RANGE BETWEEN {delta}D PRECEDING AND {delta}D FOLLOWING)")
    n = F.count("*").over(Window.partitionBy(*by))
    rows = df.withColumns({"_g": F.abs(sigmoid(z) - y), "_l": F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))})
    rows = rows.withColumn("_b", n / (near / delta + 1e-12))
    return rows.groupBy(*by).agg(F.avg(F.col("_b") * F.col("_l")).alias("loss"), F.avg("_l").alias("plain"))


def split(df: DataFrame, key: Sequence[str], share: float = 0.8, seed: int = 42) -> DataFrame:
    """Add is_train: the share of rows whose key hashes below it; the same in every run."""
    return df.withColumn("is_train", F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(10_000)) < int(share * 10_000))


def balance(df: DataFrame, label: str = "label", seed: int = 42) -> DataFrame:
    """Repeat rows of the smaller classes up to the size of the largest: whole copies, then the rows of least hash.

    Ranks come from counts per (class, hash bucket), so no class is in one task.
    """
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    most = sizes.agg(F.max("_n").alias("_most"))
    plan = sizes.crossJoin(F.broadcast(most)).select(label, F.expr("_most div _n").alias("_whole"), (F.col("_most") % F.col("_n")).alias("_more"))
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), *df.columns)).withColumn("_k", F.shiftrightunsigned("_h", 52))
    totals = hashed.groupBy(label, "_k").agg(F.count("*").alias("_m"))
    before = totals.withColumn("_before", F.sum("_m").over(Window.partitionBy(label).orderBy("_k")) - F.col("_m")).drop("_m")
    rank = F.row_number().over(Window.partitionBy(label, "_k").orderBy("_h", *df.columns)) + F.col("_before")
    copies = F.col("_whole") + (F.col("_rank") <= F.col("_more")).cast("long")
    out = hashed.join(before, [label, "_k"]).withColumn("_rank", rank).join(F.broadcast(plan), label)
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(df.columns)
