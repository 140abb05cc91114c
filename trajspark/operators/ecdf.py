"""Distributions kept as mergeable counts: written per split, merged, capped and looked up.

A store has a row for each feature and bucket: (feature, bucket, n, low, high). Counts
of splits merge by addition, so a new split is one pass over its own events. With
``accuracy`` a bucket holds values that differ by at most that share of themselves:
the store's size follows the values' range, not the events, and an ECDF value is off by
at most the share of events in its bucket. Without, a bucket is a single value and all
is exact. All features are counted in one pass and looked up in one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajspark import shared
from trajspark.functions.scalars import finite

#: Values up to this size share the bucket 0.
TINY = 1e-12
#: Keeps bucket edges off round values, on which logarithms of different engines may differ.
_OFFSET = 1_000_000.37
#: Width of the ranges in which running counts are taken, and points of a looked-up ECDF at most.
_COARSE, POINTS = 0.02, 1 << 16
#: A curve of at most so many points goes whole to the tasks that look up; longer ones are joined. Steers work, not results.
SENT = 1 << 18


def bucket_of(value: Column, accuracy: float | None) -> Column:
    """The bucket as a number that rises with the value."""
    if accuracy is None:
        return value + F.lit(0.0)
    from math import log1p

    size = F.floor(F.log(F.greatest(F.abs(value), F.lit(TINY))) / log1p(accuracy) + _OFFSET)
    return F.when(F.abs(value) <= TINY, 0.0).otherwise(F.signum(value) * size).cast("double")


def counted(df: DataFrame, features: Sequence[str], *, accuracy: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, bucket, n, low, high) of the finite values of all features."""
    each = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features))
    long = df.select(*by, F.explode(each).alias("_f")).select(*by, "_f.*").where(finite(F.col("value")))
    return long.groupBy(*by, "feature", bucket_of(F.col("value"), accuracy).alias("bucket")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


def merged(store: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of several splits as one store."""
    return store.groupBy(*by, "feature", "bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def write_split(store: DataFrame, path: str, split: str) -> None:
    """Write (or replace) one split's counts in the folder of a store."""
    store.select("feature", "bucket", "n", "low", "high").write.mode("overwrite").parquet(f"{path}/split={split}")


def read_splits(spark: SparkSession, path: str, splits: Sequence[str] | None = None) -> DataFrame:
    """The counts of some splits (by default all that are written as a whole), merged; a split that isn't there is an error."""
    held = [n.removeprefix("split=") for n in shared.children(spark, path) if n.startswith("split=") and shared.exists(spark, f"{path}/{n}/_SUCCESS")]
    wanted = held if splits is None else list(splits)
    if missing := sorted(set(wanted) - set(held)):
        raise ValueError(f"{path} lacks the splits {missing}")
    if not wanted:
        raise ValueError(f"{path} holds no splits")
    return merged(spark.read.parquet(*(f"{path}/split={s}" for s in wanted)))


def _running(store: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add upto (events up to the bucket's end) and total, of the feature (and ``by``).

    Running counts are taken inside ranges of like values, whose totals are few; so no
    window holds a feature's whole store.
    """
    keys = ["feature", *by]
    dealt = store.withColumn("_r", bucket_of(F.col("high"), _COARSE))
    whole = Window.partitionBy(*keys)
    ranges = dealt.groupBy(*keys, "_r").agg(F.sum("n").alias("_m"))
    before = ranges.select(*(F.col(k).alias(f"_key_{k}") for k in (*keys, "_r")), (F.sum("_m").over(whole.orderBy("_r")) - F.col("_m")).alias("_before"), F.sum("_m").over(whole).alias("total"))
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in (*keys, "_r")]
    upto = F.sum("n").over(Window.partitionBy(*keys, "_r").orderBy("bucket")) + F.col("_before")
    return dealt.join(before, same).withColumn("upto", upto).drop("_r", "_before", *(f"_key_{k}" for k in (*keys, "_r")))


def quantiles(store: DataFrame, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, p): an array of the quantiles, interpolated between neighbouring values; inside a bucket values count as evenly spaced.

    Found from counts by range, so neither a feature's values nor a group's meet in one task.
    """

    def ranked(k: Column) -> Column:
        """The k-th value from 0 on, null if it isn't in the bucket."""
        inside = (k >= F.col("upto") - F.col("n")) & (k < F.col("upto"))
        place = F.when(F.col("n") > 1, (k - F.col("upto") + F.col("n")) / (F.col("n") - 1)).otherwise(0.0)
        return F.when(inside, F.col("low") + place * (F.col("high") - F.col("low")))

    found = []
    for i, share in enumerate(shares):
        at = share * (F.col("total") - 1)
        below = F.floor(at)
        found += [F.max(ranked(below)).alias(f"_a{i}"), F.max(ranked(F.least(below + 1, F.col("total") - 1))).alias(f"_b{i}"), F.max(at - below).alias(f"_s{i}")]
    between = [F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * F.col(f"_s{i}") for i in range(len(shares))]
    return _running(store, by).groupBy(*by, "feature").agg(*found).select(*by, "feature", F.array(*between).alias("p"))


def capped(store: DataFrame, percent: float, signed: Sequence[str] = ()) -> DataFrame:
    """The store without values above their feature's percentile; of ``signed`` features, without those under the opposite one too."""
    ends = quantiles(store, [1 - percent / 100, percent / 100])
    low = F.when(F.col("feature").isin(list(signed)), F.col("p")[0]).otherwise(float("-inf"))
    ends = ends.select("feature", F.col("p")[1].alias("_hi"), low.alias("_lo"))
    own = store.join(F.broadcast(ends), "feature").where("low <= _hi AND high >= _lo")
    top, bottom = F.least("high", "_hi"), F.greatest("low", "_lo")
    share = F.when(F.col("high") > F.col("low"), (top - bottom) / (F.col("high") - F.col("low"))).otherwise(1.0)
    return own.select("feature", "bucket", F.greatest(F.lit(1), F.floor(share * F.col("n"))).cast("long").alias("n"), bottom.alias("low"), top.alias("high"))


def curve(store: DataFrame) -> DataFrame:
    """(feature, value, n, cdf): (average rank - 1) / (events - 1 + 1e-8) of a bucket's value, or of its two ends."""
    over = F.col("total") - 1 + 1e-8
    middle = F.struct(F.col("high").alias("value"), ((F.col("upto") - F.col("n") + (F.col("n") + 1) / 2 - 1) / over).alias("cdf"))
    ends = F.array(F.struct(F.col("low").alias("value"), ((F.col("upto") - F.col("n")) / over).alias("cdf")), F.struct(F.col("high").alias("value"), ((F.col("upto") - 1) / over).alias("cdf")))
    return _running(store).select("feature", "n", F.explode(F.when(F.col("low") == F.col("high"), F.array(middle)).otherwise(ends)).alias("p")).select("feature", "p.value", "n", "p.cdf")


def curves(store: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Of each feature the values and their cdf, ascending; at most ``POINTS`` + 3 of them reach the driver.

    A longer curve is thinned evenly over the cdf, which moves results by under
    1 / POINTS; its ends stay.
    """
    points = curve(store)
    step = F.floor(F.col("cdf") * POINTS)
    ranked = points.withColumn("_r", bucket_of(F.col("value"), _COARSE))
    thin = ranked.groupBy("feature", "_r", step.alias("_s")).agg(F.min(F.struct("value", "cdf")).alias("p")).groupBy("feature", "_s").agg(F.min("p").alias("p")).select("feature", "p.*")
    last = points.groupBy("feature").agg(F.max(F.struct("value", "cdf")).alias("p")).select("feature", "p.*")
    rows = thin.union(last).distinct().groupBy("feature").agg(F.sort_array(F.collect_list(F.struct("value", "cdf"))).alias("p")).select("feature", "p.value", "p.cdf")
    return {r.feature: (np.array(r.value), np.array(r.cdf)) for r in rows.collect()}


def _between(points: DataFrame, asked: DataFrame) -> DataFrame:
    """(feature, value, cdf) of every value asked for, linear between the curve's points.

    Neighbours are found inside ranges of like values, and beyond them from the ends of
    the ranges, which are few; so no feature's curve meets in one task.
    """
    point = F.when(F.col("cdf").isNotNull(), F.struct("value", "cdf"))
    both = points.select("feature", "value", "cdf").union(asked.select("feature", "value", F.lit(None).cast("double"))).withColumns({"_r": bucket_of(F.col("value"), _COARSE), "_p": point})
    ranges = Window.partitionBy("feature")
    ends = both.groupBy("feature", "_r").agg(F.min("_p").alias("first"), F.max("_p").alias("last")).select(
        F.col("feature").alias("_feature"),
        F.col("_r").alias("_range"),
        F.last("last", True).over(ranges.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.last("first", True).over(ranges.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"),
    )
    own, none = Window.partitionBy("feature", "_r"), F.col("cdf").isNull()
    held = both.withColumn("_lo", F.last("_p", True).over(own.orderBy("value", none))).withColumn("_hi", F.last("_p", True).over(own.orderBy(F.desc("value"), F.desc(none))))
    held = held.where(none).join(F.broadcast(ends), F.col("feature").eqNullSafe(F.col("_feature")) & (F.col("_r") == F.col("_range")))
    lo, hi, x = F.coalesce("_lo", "_before"), F.coalesce("_hi", "_after"), F.col("value")
    along = (hi["cdf"] - lo["cdf"]) / (hi["value"] - lo["value"]) * (x - lo["value"]) + lo["cdf"]
    found = F.when(lo["value"] == x, lo["cdf"]).when(lo.isNotNull() & hi.isNotNull(), along).when(lo.isNotNull(), 1.0).when(hi.isNotNull(), 0.0)
    return held.select("feature", "value", found.alias("cdf"))


def _joined(df: DataFrame, points: DataFrame, features: dict[str, str]) -> DataFrame:
    """``looked_up`` by joins on the values, for curves of any length."""
    spark = df.sparkSession
    each = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(c).cast("double").alias("value")) for c, f in features.items()))
    asked = df.select(F.explode(each).alias("_f")).select("_f.*").where("value IS NOT NULL AND NOT isnan(value)").distinct()
    found = shared.written(_between(points, asked), shared.new_path(spark, "looked_up"))
    for c, f in features.items():
        own = found.where(F.col("feature") == f).select(F.col("value").alias("_value"), F.col("cdf").alias(f"c_{c}"))
        df = df.join(own, F.col(c).cast("double") == F.col("_value"), "left").drop("_value")
    return df


def looked_up(df: DataFrame, store: DataFrame, features: dict[str, str]) -> DataFrame:
    """Add, for each ``column: feature``, c_<column>: the ECDF value of the column in the feature's distribution.

    Linear between the curve's points, all of which count, 0 below and 1 above them; null
    (and NaN) stays null, as does all of a feature that the store hasn't got.
    """
    spark = df.sparkSession
    path = shared.new_path(spark, "curve")
    points = shared.written(curve(store).where(F.col("feature").isin(list(set(features.values())))).select("feature", "value", "cdf"), path)
    longest = points.groupBy("feature").count().agg(F.max("count")).first()[0] or 0
    if longest > SENT:
        made = _joined(df, points, features)
        shared.delete(spark, path)
        return made
    rows = points.groupBy("feature").agg(F.sort_array(F.collect_list(F.struct("value", "cdf"))).alias("p")).select("feature", "p.value", "p.cdf").collect()
    known = {r.feature: (np.array(r.value), np.array(r.cdf)) for r in rows}
    shared.delete(spark, path)

    def of(feature: str):
        values, cdf = known.get(feature, (np.zeros(1), np.full(1, np.nan)))

        @F.pandas_udf("double")
        def at(x: pd.Series) -> pd.Series:
            found = np.interp(x.to_numpy(float), values, cdf, left=0.0, right=1.0) if not np.isnan(cdf[0]) else np.full(len(x), np.nan)
            return pd.Series(found).where(~np.isnan(found) & x.notna().to_numpy(), None)

        return at

    return df.withColumns({f"c_{c}": of(f)(F.col(c).cast("double")) for c, f in features.items()})
