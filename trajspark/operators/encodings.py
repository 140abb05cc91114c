"""Colour and temporal encodings of windows, in long form (keys, window_id, i, j, r, g, b).

r is a recurrence matrix, g and b hold what the column event says (stripes) or what
the pair says. Channels are shares of [0, 1]; whether r is saved first or last is left
to the writer. Features are columns of the events, usually looked up in an ECDF before
(``distribution.ecdf_lookup``), so all of this is joins and windows on one key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.functions.scalars import EPS
from trajspark.operators import recurrence as rec


def _unit(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def with_events(p: DataFrame, events: DataFrame, by: Sequence[str], columns: Sequence[str], *, of_i: bool = False) -> DataFrame:
    """Add j_<column> (and i_<column>) of the events at j (and i), where the pairs don't have them already."""
    out = p
    for side in ("j", "i") if of_i else ("j",):
        lacking = [c for c in columns if f"{side}_{c}" not in p.columns]
        if lacking:
            own = events.select(*by, "window_id", F.col("pos").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in lacking))
            out = out.join(own, [*by, "window_id", side])
    return out


def channels(p: DataFrame, by: Sequence[str], r: Column, g: Column, b: Column) -> DataFrame:
    return p.select(*by, "window_id", "i", "j", _unit(r).alias("r"), _unit(g).alias("g"), _unit(b).alias("b"))


def striped(p: DataFrame, events: DataFrame, by: Sequence[str], g: str, b: str, r: Column | None = None) -> DataFrame:
    """r: the matrix d (or the given column), g and b: stripes of the events' columns."""
    both = with_events(p, events, by, list(dict.fromkeys([g, b])))
    return channels(both, by, F.col("d") if r is None else r, F.col(f"j_{g}"), F.col(f"j_{b}"))


def split_stripe(low: str, high: str) -> Column:
    """The column event's ``low`` where i > j, its ``high`` where i < j, half their sum on the diagonal."""
    a, b = F.col(f"j_{low}"), F.col(f"j_{high}")
    return F.when(F.col("i") > F.col("j"), a).when(F.col("i") < F.col("j"), b).otherwise((a + b) / 2)


def local(df: DataFrame, by: Sequence[str], epsilon: float = 1.0) -> DataFrame:
    """Clipped distances under one local scale, stretched over the window."""
    return rec.stretched(rec.clipped(df, by, epsilon), by)


def inverted_percentile(df: DataFrame, by: Sequence[str], percent: float = 95.0) -> DataFrame:
    """One minus the stretched distances cut at a percentile of the window."""
    return rec.percentile_plot(df, by, percent).withColumn("d", 1 - F.col("d"))


def inverted_mean_cut(df: DataFrame, by: Sequence[str], other: float = 0.3) -> DataFrame:
    """One minus the distances over the window's largest, ``other`` where they exceed their mean."""
    return rec.mean_cut(df, by, other).withColumn("d", 1 - F.col("d"))


def time_pairs(p: DataFrame, events: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add gap: the absolute time between the two events."""
    both = with_events(p, events, by, ["time"], of_i=True)
    return both.withColumn("gap", F.abs(F.col("i_time") - F.col("j_time"))).drop("i_time", "j_time")


def value_differences(p: DataFrame, events: DataFrame, by: Sequence[str], column: str, percent: float = 95.0) -> DataFrame:
    """Add diff: absolute differences of ``column`` cut at a percentile of the window and stretched."""
    both = with_events(p, events, by, [column], of_i=True).withColumn("diff", F.abs(F.col(f"i_{column}") - F.col(f"j_{column}"))).drop(f"i_{column}", f"j_{column}")
    return rec.cut_and_stretched(both, by, "diff", percent)


def halves(df: DataFrame, by: Sequence[str], size: int, base, g: str, b: str) -> DataFrame:
    """Windows of even size in two halves: the first's matrix below the diagonal, the second's above, both summed on it.

    ``base`` makes a matrix from events, their keys being (events, keys); g and b are
    stripes of the half that the matrix is from, the first's on the diagonal.
    """
    half = size // 2
    parts = df.where(F.col("pos") < 2 * half).withColumns({"part": (F.col("pos") >= half).cast("long"), "pos": F.col("pos") % half})
    p = with_events(base(parts, [*by, "part"]), parts, [*by, "part"], list(dict.fromkeys([g, b])))
    side = F.when(F.col("part") == 0, F.col("i") >= F.col("j")).otherwise(F.col("i") <= F.col("j"))
    first = lambda c: F.max(F.when((F.col("part") == 0) | (F.col("i") < F.col("j")), F.col(c)))
    return p.where(side).groupBy(*by, "window_id", "i", "j").agg(_unit(F.sum("d")).alias("r"), _unit(first(f"j_{g}")).alias("g"), _unit(first(f"j_{b}")).alias("b"))


def location(df: DataFrame, by: Sequence[str], corners: Sequence[str] = ("d_br",)) -> DataFrame:
    """(by, window_id, loc): the sum of the mean distances to the corners, over all events of a window."""
    made = sum((F.avg(c) for c in corners[1:]), F.avg(corners[0]))
    return df.groupBy(*by, "window_id").agg(made.alias("loc"))


def pixel_location(p: DataFrame, events: DataFrame, by: Sequence[str], corners: Sequence[str] = ("d_br", "d_tr")) -> DataFrame:
    """Add loc: the sum over the corners of the two events' mean distance."""
    both = with_events(p, events, by, corners, of_i=True)
    loc = sum(((F.col(f"i_{c}") + F.col(f"j_{c}")) / 2 for c in corners), F.lit(0.0))
    return both.withColumn("loc", loc).drop(*(f"{s}_{c}" for s in "ij" for c in corners))


def position_and(p: DataFrame, events: DataFrame, by: Sequence[str], low: str, high: str) -> DataFrame:
    """r: d, g: stripes of the events' x_share below and y_share above the diagonal, b: of ``low`` and ``high`` likewise."""
    both = with_events(p, events, by, list(dict.fromkeys(["x_share", "y_share", low, high])))
    return channels(both, by, F.col("d"), split_stripe("x_share", "y_share"), split_stripe(low, high))


def half_stripe(low: str, high: str, size: int) -> Column:
    """The column event's ``high`` in the upper half of the rows, its ``low`` in the lower: rectangles in which all events have the same area."""
    return F.when(F.col("i") < size // 2, F.col(f"j_{high}")).otherwise(F.col(f"j_{low}"))


def position_halves(p: DataFrame, events: DataFrame, by: Sequence[str], size: int, low: str | None = None, high: str | None = None) -> DataFrame:
    """r: d, g: half stripes of x_share and y_share, b: of ``low`` and ``high`` likewise, or d where none is given."""
    both = with_events(p, events, by, list(dict.fromkeys(["x_share", "y_share", *([low, high] if low else [])])))
    return channels(both, by, F.col("d"), half_stripe("x_share", "y_share", size), half_stripe(low, high, size) if low else F.col("d"))


def position_triangles(p: DataFrame, events: DataFrame, by: Sequence[str]) -> DataFrame:
    """r and b: d, g: stripes of x_share below and y_share above the diagonal."""
    both = with_events(p, events, by, ["x_share", "y_share"])
    return channels(both, by, F.col("d"), split_stripe("x_share", "y_share"), F.col("d"))


def shares(df: DataFrame) -> DataFrame:
    """Add x_share and y_share: the place between the bounds (min_x, max_x, min_y, max_y)."""
    return df.withColumns({f"{c}_share": (F.col(c) - F.col(f"min_{c}")) / F.greatest(F.col(f"max_{c}") - F.col(f"min_{c}"), F.lit(EPS)) for c in "xy"})


def corner_stripes(p: DataFrame, events: DataFrame, by: Sequence[str]) -> DataFrame:
    """value: stripes of the distance to the bottom-right corner below the diagonal, to the top-right above."""
    both = with_events(p, events, by, ["d_br", "d_tr"])
    return both.select(*by, "window_id", "i", "j", _unit(split_stripe("d_br", "d_tr")).alias("value"))


def corner_triangle(p: DataFrame, events: DataFrame, by: Sequence[str]) -> DataFrame:
    """value: d above and on the diagonal, stripes of (d_br - d_tr + 1) / 2 below."""
    both = with_events(p, events, by, ["d_br", "d_tr"])
    stripe = (F.col("j_d_br") - F.col("j_d_tr") + 1) / 2
    return both.select(*by, "window_id", "i", "j", F.when(F.col("i") > F.col("j"), stripe).otherwise(F.col("d")).alias("value"))


def colour_grid(df: DataFrame, by: Sequence[str], size: int, k: int, g: str, b: str, epsilon: float = 1.0) -> DataFrame:
    """(by, window_id, row, col, i, j, r, g, b): k by k cells of sub-sequences as bytes.

    Cell (row, col) has the row's part below the diagonal and the column's above; the
    diagonal is the row's where both are the same, else 0. r: distances under the
    sub-sequence's own scale, stretched between the extremes of the whole window's matrix;
    g and b: stripes of the column event's values. Without images' resizing; events
    after k equal parts are left out of the cells.
    """
    part = size // k
    ends = rec.clipped(df, by, epsilon).groupBy(*by, "window_id").agg(F.min("d").alias("_lo"), F.max("d").alias("_hi"))
    parts = df.where(F.col("pos") < part * k).withColumns({"part": F.floor(F.col("pos") / part).cast("long"), "pos": F.col("pos") % part})
    p = rec.clipped(parts, [*by, "part"], epsilon).join(ends, [*by, "window_id"])
    cut = lambda c: (_unit(c) * 255).cast("long")
    made = F.struct(cut((F.col("d") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(EPS))).alias("r"), cut(F.col(f"j_{g}")).alias("g"), cut(F.col(f"j_{b}")).alias("b"))
    own = p.select(*by, "window_id", "part", "i", "j", made.alias("c"))
    keys = [*by, "window_id", "i", "j"]
    both = own.withColumnsRenamed({"part": "row", "c": "_a"}).join(own.withColumnsRenamed({"part": "col", "c": "_b"}), keys)
    zero = F.lit(0).cast("long")
    channel = lambda c: F.when(F.col("i") < F.col("j"), F.col("_b")[c]).when((F.col("i") > F.col("j")) | (F.col("row") == F.col("col")), F.col("_a")[c]).otherwise(zero)
    return both.select(*by, "window_id", "row", "col", "i", "j", *(channel(c).alias(c) for c in "rgb"))


def pair_share(k: int) -> Column:
    """The index of the pair's unordered patches (i_patch, j_patch of a k-by-k grid) as a share of the last index."""
    patches = k * k
    return rec.unordered_index(F.col("i_patch"), F.col("j_patch")) / (patches * (patches - 1) // 2 + patches - 1)


def patch_triangle(df: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """value: the stretched matrix above and on the diagonal, the pair's patches as a share below; events have patch (see ``recurrence.patch_pair``)."""
    return rec.triangle(local(df, by), F.col("d"), pair_share(k), F.col("d"))
