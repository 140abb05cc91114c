"""Empirical distributions: summaries, caps, ranks, lookups, histograms, densities.

Scalars of a distribution (percentiles, bounds) stay in the plan as one-row frames
that are joined by broadcast; nothing is collected while a query is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.operators import ecdf


def summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """n, min, q1, median, q3, max, mean and population deviation; percentiles are exact, and no group's values meet in one task."""
    whole = df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    q = ecdf.quantiles(ecdf.counted(df, [value], by=by), (0.25, 0.5, 0.75), by).drop("feature").withColumnsRenamed({k: f"_key_{k}" for k in by})
    out = whole.join(q, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in by] or F.lit(True), "left")
    return out.select(*by, "n", "min", F.col("p")[0].alias("q1"), F.col("p")[1].alias("median"), F.col("p")[2].alias("q3"), "max", "mean", "std")


def percentiles(df: DataFrame, value: str, shares: Sequence[float], *, accuracy: int | None = None) -> DataFrame:
    """One row with array ``p`` (none, if there are no values); exact from counts by range, or approximate with the given accuracy."""
    if accuracy is None:
        return ecdf.quantiles(ecdf.counted(df, [value]), shares).select("p")
    return df.agg(F.percentile_approx(value, F.array(*map(F.lit, shares)), accuracy).alias("p"))


def _with(df: DataFrame, one_row: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(one_row))


def percentile_cap(df: DataFrame, value: str, percent: float, how: str = "upper", *, accuracy: int | None = None) -> DataFrame:
    """Rows up to a percentile ('upper'), in the central range of ``percent`` ('central'), between 100-p and p ('signed'), or whose size is up to it ('abs')."""
    if how == "abs":
        one = percentiles(df.select(F.abs(value).alias("_v")), "_v", [percent / 100], accuracy=accuracy)
        return _with(df, one).where(F.abs(value) <= F.col("p")[0]).drop("p")
    tail = {"upper": 0.0, "central": (100 - percent) / 200, "signed": (100 - percent) / 100}[how]
    high = {"upper": percent / 100, "central": 1 - tail, "signed": percent / 100}[how]
    kept = F.col(value) <= F.col("p")[1]
    return _with(df, percentiles(df, value, [tail, high], accuracy=accuracy)).where(kept if how == "upper" else kept & (F.col(value) >= F.col("p")[0])).drop("p")


def iqr_cap(df: DataFrame, value: str, k: float = 1.5, *, non_negative: bool = False, accuracy: int | None = None) -> DataFrame:
    """Rows inside the quartiles widened by k ranges between them; all rows if there is no range."""
    q1, q3 = F.col("p")[0], F.col("p")[1]
    low = q1 - k * (q3 - q1)
    low = F.greatest(low, F.lit(0.0)) if non_negative else low
    inside = (F.col(value) >= low) & (F.col(value) <= q3 + k * (q3 - q1))
    return _with(df, percentiles(df, value, [0.25, 0.75], accuracy=accuracy)).where((q3 <= q1) | inside).drop("p")


def global_ecdf(df: DataFrame, value: str, buckets: int = 256) -> DataFrame:
    """(value, n, cdf) of the distinct values: (average rank - 1) / (n - 1 + 1e-8).

    Values are counted first. Approximate quantiles split them into ``buckets``
    ranges; running counts within a range and the ranges' totals give ranks
    without a window over all rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    cuts = counts.agg(F.array_distinct(F.percentile_approx("value", F.array(*(F.lit(i / buckets) for i in range(1, buckets))), 10_000)).alias("cuts"))
    dealt = _with(counts, cuts).withColumn("bucket", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")
    totals = dealt.groupBy("bucket").agg(F.sum("n").alias("m"))
    before = totals.select("bucket", (F.sum("m").over(Window.orderBy("bucket")) - F.col("m")).alias("before"), F.sum("m").over(Window.partitionBy()).alias("total"))
    upto = F.sum("n").over(Window.partitionBy("bucket").orderBy("value")) + F.col("before")
    ranked = dealt.join(F.broadcast(before), "bucket").withColumn("rank", upto - F.col("n") + (F.col("n") + 1) / 2)
    return ranked.select("value", "n", ((F.col("rank") - 1) / (F.col("total") - 1 + 1e-8)).alias("cdf"))


def ecdf_lookup(df: DataFrame, value: str, ecdf: DataFrame, *, points: int = 1 << 16) -> DataFrame:
    """Add ``cdf``: linear interpolation in (value, cdf) pairs, 0 below and 1 above them.

    Pairs are sent to the executors as a sorted array of at most ``points`` + 1: beyond
    so many different values an ECDF is thinned, which moves results by under 1 / points.
    """
    table = thin(ecdf, points).agg(F.sort_array(F.collect_list(F.struct(F.col("value").cast("double").alias("v"), "cdf"))).alias("e"))
    x = F.col(value).cast("double")

    def search(e: Column) -> Column:
        """Index of the first pair that isn't below x, by halving."""
        span = F.aggregate(
            F.sequence(F.lit(0), F.lit(32)),
            F.struct(F.lit(0).alias("lo"), F.size(e).alias("hi")),
            lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(
                F.when(F.get(e, F.shiftright(s["lo"] + s["hi"], 1))["v"] < x, F.struct((F.shiftright(s["lo"] + s["hi"], 1) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), F.shiftright(s["lo"] + s["hi"], 1).alias("hi")))
            ),
        )
        return span["lo"]

    out = _with(df, table).withColumn("_i", search(F.col("e")))
    high, low = F.get("e", F.col("_i")), F.get("e", F.col("_i") - 1)
    between = low["cdf"] + (high["cdf"] - low["cdf"]) * (x - low["v"]) / (high["v"] - low["v"])
    found = F.when(x.isNull(), None).when(F.col("_i") >= F.size("e"), 1.0).when(high["v"] == x, high["cdf"]).when(F.col("_i") == 0, 0.0).otherwise(between)
    # At or beyond the last value numpy-style interpolation keeps its own cdf.
    return out.withColumn("cdf", found).drop("e", "_i")


def thin(ecdf: DataFrame, points: int) -> DataFrame:
    """At most ``points`` + 1 pairs, evenly over the cdf; the first and the last stay."""
    w = Window.partitionBy(F.floor(F.col("cdf") * points))
    ends = ecdf.agg(F.max("value").alias("_hi"))
    return _with(ecdf.withColumn("_m", F.min("value").over(w)), ends).where((F.col("value") == F.col("_m")) | (F.col("value") == F.col("_hi"))).drop("_m", "_hi")


def histogram(df: DataFrame, value: str, bins: int, *, clip_percent: float | None = None) -> DataFrame:
    """(bin, low, high, n) of equal widths from the least to the largest value; the last bin is closed. Empty bins are left out."""
    kept = percentile_cap(df, value, clip_percent) if clip_percent is not None else df
    ends = kept.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0).cast("long")
    out = _with(kept.where(F.col(value).isNotNull()), ends).groupBy(at.alias("bin"), "_lo", "_hi").agg(F.count("*").alias("n"))
    return out.select("bin", (F.col("_lo") + F.col("bin") * width).alias("low"), (F.col("_lo") + (F.col("bin") + 1) * width).alias("high"), "n")


def density(df: DataFrame, value: str, points: int = 64, *, cells: int = 2048) -> DataFrame:
    """(grid, density): Gaussian kernel estimate on an even grid, its peak scaled to 1.

    Bandwidth by Scott's rule. Values are first counted in ``cells`` narrow cells
    whose centres carry the mass, so grid times cells bounds the work at any size;
    with at most that many distinct values counting is exact.
    """
    stats = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("m"), F.stddev_samp(value).alias("sd"))
    h = F.col("sd") * F.pow(F.col("m").cast("double"), F.lit(-0.2))
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("w"))
    grid = stats.withColumn("h", h).select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k")).withColumn("grid", F.col("lo") + F.col("k") * (F.col("hi") - F.col("lo")) / (points - 1))
    cell = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * cells), F.lit(cells - 1))
    massed = _with(counted, stats.select("lo", "hi")).groupBy(cell.alias("c")).agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"), F.sum("w").alias("w"))
    z = (F.col("grid") - F.col("v")) / F.col("h")
    raw = massed.crossJoin(F.broadcast(grid)).groupBy("k", "grid").agg(F.sum(F.col("w") * F.exp(-0.5 * z * z)).alias("d"))
    peak = raw.agg(F.max("d").alias("peak"))
    return _with(raw, peak).select("grid", (F.col("d") / F.col("peak")).alias("density"))


def padded_limits(df: DataFrame, value: str, share: float = 0.03) -> DataFrame:
    """(low, high) of all values with a margin on both sides."""
    lo, hi = F.min(value), F.max(value)
    return df.agg((lo - share * (hi - lo)).alias("low"), (hi + share * (hi - lo)).alias("high"))
