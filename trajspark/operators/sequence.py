"""Segmentation of ordered events: gaps, arc length, greedy merge, windows, folds.

All functions take events with key columns ``by`` that name a session, and ``seq``
counting 0, 1, 2, ... in order. Partitioning is by session throughout, so a chain
of them shuffles once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(by: Sequence[str]):
    return Window.partitionBy(*by).orderBy("seq")


def steps(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add dx, dy, dt and step (Euclidean) from the event before; null at the first."""
    w = ordered(by)
    out = df.withColumns({"dx": F.col("x") - F.lag("x").over(w), "dy": F.col("y") - F.lag("y").over(w), "dt": F.col("time") - F.lag("time").over(w)})
    return out.withColumn("step", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))


def gap_split(df: DataFrame, by: Sequence[str], gap: float) -> DataFrame:
    """Add sequence_id: a new sequence starts where time moved by more than ``gap``."""
    w = ordered(by)
    new = (F.col("time") - F.lag("time").over(w) > gap).cast("int")
    return df.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("sequence_id", F.sum("_new").over(w).cast("long")).drop("_new")


def arc_length(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add arc: length of the path from the session's first event."""
    return steps(df, by).withColumn("arc", F.coalesce(F.sum("step").over(ordered(by)), F.lit(0.0))).drop("dx", "dy", "dt", "step")


def greedy_merge(df: DataFrame, by: Sequence[str], min_length: Column) -> DataFrame:
    """Add group_id: sequences joined left to right until each is ``min_length`` long.

    df has sequence_id. A group's length runs along the session's whole path from
    its first event to its last, steps between sequences included; the last group
    may stay short. ``min_length`` is an aggregate over a session, as max(x).
    One small struct a sequence is folded per session, not the events.
    """
    arcs = arc_length(df, by)
    spans = arcs.groupBy(*by, "sequence_id").agg(F.min("arc").alias("a"), F.max("arc").alias("b"))
    bound = df.groupBy(*by).agg(min_length.cast("double").alias("_least"))
    per = spans.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("sequence_id", "a", "b"))).alias("spans")).join(bound, list(by))
    zero = F.struct(F.lit(None).cast("double").alias("start"), F.lit(0).cast("long").alias("group"), F.array().cast("array<bigint>").alias("out"))

    def fold(state: Column, s: Column) -> Column:
        start = F.coalesce(state["start"], s["a"])
        full = s["b"] - start >= F.col("_least")
        return F.struct(F.when(~full, start).alias("start"), (state["group"] + full.cast("long")).alias("group"), F.concat(state["out"], F.array(state["group"])).alias("out"))

    groups = F.aggregate("spans", zero, fold)["out"]
    mapped = per.select(*by, F.explode(F.arrays_zip(F.col("spans.sequence_id").alias("sequence_id"), groups.alias("group_id"))).alias("m")).select(*by, "m.sequence_id", "m.group_id")
    return df.join(mapped, [*by, "sequence_id"])


def renumbered(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """``column`` as window_id, with pos counting its events from 0 on and _n their number."""
    w = Window.partitionBy(*by, column)
    return df.withColumns({"pos": (F.row_number().over(w.orderBy("seq")) - 1).cast("long"), "_n": F.count("*").over(w)}).withColumnRenamed(column, "window_id")


def tumbling(df: DataFrame, by: Sequence[str], size: int, *, ragged: bool = False, least: int = 2) -> DataFrame:
    """Add window_id and pos for consecutive windows of ``size`` events.

    Strict windows drop the rest of a session; ragged ones keep it if it has
    ``least`` events or more.
    """
    out = df.withColumns({"window_id": F.floor(F.col("seq") / size).cast("long"), "pos": (F.col("seq") % size).cast("long")})
    total = F.count("*").over(Window.partitionBy(*by))
    held = F.least(F.lit(size), total - F.col("window_id") * size)
    return out.withColumn("_n", held).where(F.col("_n") >= (least if ragged else size)).drop("_n")


def sliding(df: DataFrame, by: Sequence[str], size: int, stride: int) -> DataFrame:
    """Rows of all whole windows that start every ``stride`` events, with window_id and pos."""
    total = F.count("*").over(Window.partitionBy(*by))
    first = F.greatest(F.lit(0), F.ceil((F.col("seq") - size + 1) / stride))
    last = F.least(F.floor(F.col("seq") / stride), F.floor((F.col("_n") - size) / stride))
    out = df.withColumn("_n", total).where(F.col("_n") >= size).withColumns({"_f": first.cast("long"), "_l": last.cast("long")}).where("_f <= _l")
    return out.withColumn("window_id", F.explode(F.sequence("_f", "_l"))).withColumn("pos", F.col("seq") - F.col("window_id") * stride).drop("_n", "_f", "_l")


def window_count(n: Column, size: int, stride: int) -> Column:
    return F.when(n >= size, F.floor((n - size) / stride) + 1).otherwise(0).cast("long")


def folds(df: DataFrame, by: Sequence[str], k: int = 5) -> DataFrame:
    """Add fold: k contiguous ranges with bounds floor(i * n / k)."""
    n = F.count("*").over(Window.partitionBy(*by))
    return df.withColumn("_n", n).withColumn("fold", F.expr(f"cast(((seq + 1) * {k} - 1) div _n as long)")).drop("_n")


def subsequences(df: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """Add part: k equal ranges, the last takes the rest; sessions of under k events are dropped."""
    n = F.count("*").over(Window.partitionBy(*by))
    return df.withColumn("_n", n).where(F.col("_n") >= k).withColumn("part", F.least(F.expr(f"seq div (_n div {k})"), F.lit(k - 1)).cast("long")).drop("_n")


def halves(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add half: 0 for the first n div 2 events, else 1."""
    n = F.count("*").over(Window.partitionBy(*by))
    return df.withColumn("_n", n).withColumn("half", F.expr("cast(seq >= _n div 2 as long)")).drop("_n")
