"""Pairwise recurrence of the events in a window, in long form (keys, window_id, i, j, value).

Windows have a fixed number of events, so pairs grow with the events, not with
sessions. A window's columns are gathered in one row and its pairs exploded from it, so
neither pairs nor the events' columns at i and j need a join; statistics of a window
come from window functions over its keys. All of it runs on the events' partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions.scalars import EPS, min_max, to_byte


def _w(by: Sequence[str]):
    return Window.partitionBy(*by, "window_id")


def local_scale(df: DataFrame, by: Sequence[str], how: str = "one") -> DataFrame:
    """Coordinates from the window's least, over one scale for both axes ('one') or one each ('axis')."""
    w = _w(by)
    ranges = {c: F.greatest(F.max(c).over(w) - F.min(c).over(w), F.lit(EPS)) for c in "xy"}
    if how == "one":
        ranges = dict.fromkeys("xy", F.greatest(*ranges.values()))
    return df.withColumns({f"_{c}": (F.col(c) - F.min(c).over(w)) / r for c, r in ranges.items()}).drop("x", "y").withColumnsRenamed({"_x": "x", "_y": "y"})


def pairs(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, window_id, i, j, d): Euclidean distances of all pairs, i = j included.

    Every further column c of the events comes along as i_c and j_c; those that
    nothing uses are never gathered.
    """
    return _exploded(*_held(df, by), by)


def _held(df: DataFrame, by: Sequence[str], each: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """One row a window with its columns as arrays, ``each`` being one value a window, and the names of the further columns."""
    keys = [*by, "window_id"]
    others = [c for c in df.columns if c not in (*keys, *each, "pos", "x", "y")]
    return df.groupBy(*keys).agg(*(F.first(c).alias(c) for c in each), *(F.collect_list(F.struct(F.col(c).alias("v"))).alias(f"_{c}") for c in ("pos", "x", "y", *others))), others


def _distance(i: Column, j: Column) -> Column:
    dx, dy = (F.get(F.col(f"_{c}"), i)["v"] - F.get(F.col(f"_{c}"), j)["v"] for c in "xy")
    return F.sqrt(dx * dx + dy * dy)


_PLACES = "sequence(0, size(_pos) - 1)"


def _exploded(held: DataFrame, others: Sequence[str], by: Sequence[str], *more: str) -> DataFrame:
    out = held.withColumn("__i", F.explode(F.expr(_PLACES))).withColumn("__j", F.explode(F.expr(_PLACES)))
    at = lambda c, k: F.get(F.col(f"_{c}"), F.col(k))["v"]
    kept = [F.get(F.col(c), F.col(k)).alias(f"_m{k[-1]}") for c in more for k in ("__i", "__j")]
    return out.select(*by, "window_id", at("pos", "__i").alias("i"), at("pos", "__j").alias("j"), *(at(c, k).alias(f"{n}_{c}") for c in others for n, k in (("i", "__i"), ("j", "__j"))), _distance(F.col("__i"), F.col("__j")).alias("d"), *kept, *(c for c in held.columns if c in ("_lo", "_hi")))


def gated_pairs(df: DataFrame, by: Sequence[str], epsilon: float, scaled: Callable[[Column], Column] = lambda d: d, *, strict: bool = True, other: float | None = None, each: Sequence[str] = ()) -> DataFrame:
    """``mean_gate`` of the pairs with d as ``scaled``, the means taken inside a window's row: pairs are never sorted.

    each: columns of df (_lo, _hi) that are one value a window, for ``scaled``.
    """
    held, others = _held(df, by, each)
    apart = lambda i: lambda s, j: F.coalesce(s + F.when(i != j, scaled(_distance(i, j))), s, F.when(i != j, scaled(_distance(i, j))))
    mean = lambda i: F.try_divide(F.aggregate(F.expr(_PLACES), F.lit(None).cast("double"), apart(i)), F.size("_pos") - 1)
    p = _exploded(held.withColumn("__means", F.transform(F.expr(_PLACES), mean)), others, by, "__means")
    near = lambda m: (F.col(m) < epsilon) if strict else (F.col(m) <= epsilon)
    out = p.withColumns({"recurrent": near("_mi") & near("_mj"), "d": scaled(F.col("d"))})
    return out.withColumn("d", F.when(F.col("recurrent"), F.col("d")).otherwise(F.lit(epsilon if other is None else other))).drop("_mi", "_mj", *each)


def clipped(df: DataFrame, by: Sequence[str], epsilon: float = 1.0) -> DataFrame:
    """Distances under one local scale, up to epsilon, as column d."""
    return pairs(local_scale(df, by), by).withColumn("d", F.least("d", F.lit(epsilon)))


def stretched(p: DataFrame, by: Sequence[str], value: str = "d") -> DataFrame:
    """Values of a window stretched to [0, 1] and as bytes (pixel)."""
    w = _w(by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return p.withColumn(value, min_max(F.col(value), low, high)).withColumn("pixel", to_byte(F.col(value)))


def cut_and_stretched(p: DataFrame, by: Sequence[str], value: str, percent: float) -> DataFrame:
    """``value`` cut at a percentile of the window and stretched; constant windows keep their value."""
    w = _w(by)
    out = p.withColumn(value, F.least(value, F.percentile(value, F.lit(percent / 100)).over(w)))
    low, high = F.min(value).over(w), F.max(value).over(w)
    return out.withColumn(value, F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(F.col(value)))


def percentile_plot(df: DataFrame, by: Sequence[str], percent: float = 95.0) -> DataFrame:
    """Raw distances cut at a percentile of the window and stretched."""
    return cut_and_stretched(pairs(df, by), by, "d", percent)


def mean_cut(df: DataFrame, by: Sequence[str], other: float = 0.3) -> DataFrame:
    """Distances over the window's largest; ``other`` where they exceed their mean."""
    w = _w(by)
    p = pairs(df, by).withColumn("_m", F.max("d").over(w)).withColumn("d", F.col("d") / (F.col("_m") + EPS))
    return p.withColumn("_m", F.avg("d").over(w)).withColumn("d", F.when(F.col("d") > F.col("_m"), F.lit(other)).otherwise(F.col("d"))).drop("_m")


def mean_gate(p: DataFrame, by: Sequence[str], epsilon: float, *, strict: bool = True, other: float | None = None) -> DataFrame:
    """Keep d where both points' mean distance to the others is under epsilon; else epsilon (or ``other``). Adds recurrent."""
    others = lambda k: Window.partitionBy(*by, "window_id", k)
    mean = lambda k: F.sum(F.when(F.col("i") != F.col("j"), F.col("d"))).over(others(k)) / (F.count("*").over(others(k)) - 1)
    near = lambda m: (m < epsilon) if strict else (m <= epsilon)
    both = near(mean("i")) & near(mean("j"))
    return p.withColumn("recurrent", both).withColumn("d", F.when(F.col("recurrent"), F.col("d")).otherwise(F.lit(epsilon if other is None else other)))


def gated(df: DataFrame, by: Sequence[str], epsilon: float) -> DataFrame:
    """Distances under a scale per axis, gated by mean distance."""
    return gated_pairs(local_scale(df, by, "axis"), by, epsilon)


def gated_share(df: DataFrame, by: Sequence[str], epsilon: float) -> DataFrame:
    """As ``gated`` with d / epsilon where both points recur, 0 elsewhere and on the diagonal."""
    p = gated_pairs(local_scale(df, by, "axis"), by, epsilon, other=0.0)
    return p.withColumn("d", F.when(F.col("i") != F.col("j"), F.col("d") / epsilon).otherwise(0.0))


def unit_gated(df: DataFrame, by: Sequence[str], epsilon: float) -> DataFrame:
    """Distances under one scale over the root of two, gated by mean distance, up to epsilon."""
    return gated_pairs(local_scale(df, by), by, epsilon, lambda d: d / F.sqrt(F.lit(2.0))).withColumn("d", F.least("d", F.lit(epsilon)))


def global_gated(df: DataFrame, by: Sequence[str], epsilon: float, *, clip: bool = True) -> DataFrame:
    """As ``gated`` with coordinates between the extremes of all events; ``clip``: up to epsilon."""
    ends = df.agg(*(f(c).alias(f"_{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))))
    scaled = df.crossJoin(F.broadcast(ends)).withColumns({c: (F.col(c) - F.col(f"_lo{c}")) / F.greatest(F.col(f"_hi{c}") - F.col(f"_lo{c}"), F.lit(EPS)) for c in "xy"})
    p = gated_pairs(scaled.select(*df.columns), by, epsilon)
    return p.withColumn("d", F.least("d", F.lit(epsilon))) if clip else p


def bounded_gate(df: DataFrame, by: Sequence[str], epsilon: float, scope: Sequence[str] = (), *, strict: bool = False) -> DataFrame:
    """Two phases: extreme off-diagonal distances of ``scope`` (all, or a session) normalise d, the diagonal too; kept ones go up to epsilon.

    A point recurs if its mean distance to the others is at most (``strict``: under) epsilon.
    """
    ends = pairs(df, by).where("i <> j").groupBy(*scope).agg(F.min("d").alias("_lo"), F.max("d").alias("_hi"))
    joined = df.join(ends, list(scope)) if scope else df.crossJoin(F.broadcast(ends))
    return gated_pairs(joined, by, epsilon, lambda d: (d - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + EPS), strict=strict, each=["_lo", "_hi"]).withColumn("d", F.least("d", F.lit(epsilon)))


def previous_difference(p: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add diff: d minus that of the session's window before; null in the first window."""
    w = Window.partitionBy(*by, "i", "j").orderBy("window_id")
    return p.withColumn("diff", F.when(F.lag("window_id").over(w) == F.col("window_id") - 1, F.col("d") - F.lag("d").over(w)))


def difference_bytes(p: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add diff as ``previous_difference``, stretched over the window, and as bytes (pixel); first windows are left out."""
    return stretched(previous_difference(p, by).where("diff IS NOT NULL"), by, "diff")


def triangle(p: DataFrame, upper: Column, lower: Column, diagonal: Column) -> DataFrame:
    """value: upper where i < j, lower where i > j, else diagonal."""
    return p.withColumn("value", F.when(F.col("i") < F.col("j"), upper).when(F.col("i") > F.col("j"), lower).otherwise(diagonal))


def half_triangles(df: DataFrame, by: Sequence[str], size: int, other: float = 0.3) -> DataFrame:
    """One mean-cut matrix of the window: the first half's part above the diagonal, the second's below, 0 on it; an odd last event is left out."""
    half = size // 2
    p = mean_cut(df.where(F.col("pos") < 2 * half), by, other).withColumns({"part": (F.col("i") >= half).cast("long"), "i": F.col("i") % half, "j": F.when(F.floor(F.col("i") / half) == F.floor(F.col("j") / half), F.col("j") % half)})
    p = p.where(F.col("j").isNotNull() & F.when(F.col("part") == 0, F.col("i") <= F.col("j")).otherwise(F.col("i") > F.col("j")))
    return p.select(*by, "window_id", "i", "j", F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.col("d")).alias("value"))


def grid_of_pairs(df: DataFrame, by: Sequence[str], size: int, k: int, epsilon: float = 1.0) -> DataFrame:
    """k by k cells of sub-sequences as bytes: cell (a, b) has a's part of the matrix below the diagonal and b's above.

    Scale and stretch are the whole window's. The diagonal is a's where a = b, else 0.
    Without images' resizing; events after k equal parts are left out of the cells.
    """
    part = size // k
    p = stretched(clipped(df, by, epsilon), by).where((F.col("i") < part * k) & (F.floor(F.col("i") / part) == F.floor(F.col("j") / part)))
    p = p.select(*by, "window_id", F.floor(F.col("i") / part).cast("long").alias("part"), (F.col("i") % part).alias("i"), (F.col("j") % part).alias("j"), F.col("pixel").alias("_d"))
    keys = [*by, "window_id", "i", "j"]
    a, b = p.withColumnRenamed("part", "a").withColumnRenamed("_d", "da"), p.withColumnRenamed("part", "b").withColumnRenamed("_d", "db")
    return triangle(a.join(b, keys), F.col("db"), F.col("da"), F.when(F.col("a") == F.col("b"), F.col("da")).otherwise(0)).drop("da", "db")


def stripes(p: DataFrame, lower: str, upper: str) -> DataFrame:
    """Add stripe: the column event's ``lower`` where i > j, its ``upper`` where i < j, half their sum on the diagonal."""
    low, high = F.col(f"j_{lower}"), F.col(f"j_{upper}")
    return triangle(p, high, low, (high + low) / 2).withColumnRenamed("value", "stripe")


def diagonal_scaled(df: DataFrame, by: Sequence[str], epsilon: float = 1.0) -> DataFrame:
    """Distances over the diagonal of the user's bounds (column diag), up to epsilon, no local stretch."""
    scale = F.greatest("diag", F.lit(EPS))
    return pairs(df.withColumns({"x": F.col("x") / scale, "y": F.col("y") / scale}), by).withColumn("d", F.least("d", F.lit(epsilon)))


def corner_distances(df: DataFrame) -> DataFrame:
    """Add d_br and d_tr: distance to the bottom-right and top-right corner of the bounds over their diagonal."""
    dx, scale = F.col("max_x") - F.col("x"), F.greatest("diag", F.lit(EPS))
    to = lambda dy: F.sqrt(dx * dx + dy * dy) / scale
    return df.withColumns({"d_br": to(F.col("max_y") - F.col("y")), "d_tr": to(F.col("y") - F.col("min_y"))})


def location_bias(p: DataFrame, alpha: Column, gamma: float, how: str = "mix") -> DataFrame:
    """A finished matrix (d in [0, 1]) pulled by a location term: mixed, added and clipped, or added and rescaled."""
    made = {"mix": (1 - gamma) * F.col("d") + gamma * alpha, "clip": F.least(F.greatest(F.col("d") + gamma * alpha, F.lit(0.0)), F.lit(1.0)), "scale": (F.col("d") + gamma * alpha) / (1 + gamma)}
    return p.withColumn("d", made[how])


def patch_pair(df: DataFrame, k: int) -> DataFrame:
    """Add patch: index of the event's cell in a k-by-k grid of the bounds."""
    cell = lambda c: F.least(F.greatest(F.floor((F.col(c) - F.col(f"min_{c}")) / F.greatest(F.col(f"max_{c}") - F.col(f"min_{c}"), F.lit(EPS)) * k), F.lit(0)), F.lit(k - 1))
    return df.withColumn("patch", (cell("y") * k + cell("x")).cast("long"))


def unordered_index(a: Column, b: Column) -> Column:
    """Index of an unordered pair of numbers from 0 on, equal ones included."""
    high, low = F.greatest(a, b), F.least(a, b)
    return (high * (high + 1) / 2 + low).cast("long")


def recurrence_counts(p: DataFrame, epsilon: float) -> DataFrame:
    """Pairs i <> j at or under epsilon and above it, with their share."""
    near = F.count_if(F.col("d") <= epsilon)
    return p.where("i <> j").agg(near.alias("below"), F.count_if(F.col("d") > epsilon).alias("above"), (near / F.count("*")).alias("ratio"))
