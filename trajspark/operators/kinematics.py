"""Per-event kinematics by window functions over ordered sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions.scalars import EPS, MIN_DT, finite, wrap_angle
from trajspark.operators.sequence import ordered


def _diff(name: str, w) -> Column:
    return F.col(name) - F.lag(name).over(w)


def _dt(w) -> Column:
    return F.greatest(_diff("time", w), F.lit(MIN_DT))


def _first(df: DataFrame, names: Sequence[str], w, first: str) -> DataFrame:
    """Fill the first event's values: zero, or copied from the second ('copy'); 'drop' leaves null."""
    fill = {"zero": lambda c: F.coalesce(c, F.lit(0.0)), "copy": lambda c: F.coalesce(c, F.lead(c).over(w), F.lit(0.0)), "drop": lambda c: c}[first]
    return df.withColumns({n: fill(F.col(n)) for n in names})


def speed(df: DataFrame, by: Sequence[str], first: str = "zero") -> DataFrame:
    """Add v: distance over time since the event before, time clamped from below."""
    w = ordered(by)
    dx, dy = _diff("x", w), _diff("y", w)
    return _first(df.withColumn("v", F.sqrt(dx * dx + dy * dy) / _dt(w)), ["v"], w, first)


def velocity(df: DataFrame, by: Sequence[str], first: str = "zero") -> DataFrame:
    """Add signed vx and vy."""
    w = ordered(by)
    return _first(df.withColumns({"vx": _diff("x", w) / _dt(w), "vy": _diff("y", w) / _dt(w)}), ["vx", "vy"], w, first)


def acceleration(df: DataFrame, by: Sequence[str], first: str = "zero", *, least: int = 3) -> DataFrame:
    """Add v and a: change of v over time; 0 at the first event. Non-finite values count as 0; sessions of under ``least`` events have a = 0."""
    w = ordered(by)
    out = speed(df, by, first)
    a = F.coalesce(_diff("v", w) / _dt(w), F.lit(0.0))
    n = F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return out.withColumn("a", F.when((n >= least) & finite(a), a).otherwise(0.0))


def component_acceleration(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add vx, vy (first copied) and ax, ay, 0 at the first event."""
    w = ordered(by)
    out = velocity(df, by, "copy")
    return out.withColumns({"ax": F.coalesce(_diff("vx", w) / _dt(w), F.lit(0.0)), "ay": F.coalesce(_diff("vy", w) / _dt(w), F.lit(0.0))})


def segments(df: DataFrame, by: Sequence[str], guard: float = MIN_DT) -> DataFrame:
    """(by, seq, dt, vx, vy, v): one row per step between two events, none for the first; v from vx and vy."""
    w = ordered(by)
    dt = F.greatest(_diff("time", w), F.lit(guard))
    out = df.withColumns({"dt": dt, "vx": _diff("x", w) / dt, "vy": _diff("y", w) / dt}).where(F.col("dt").isNotNull())
    return out.select(*by, "seq", "dt", "vx", "vy", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")).alias("v"))


def segment_acceleration(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, seq, a, ax, ay) per step: change of v, vx and vy since the step before over its time; 0 at the first step and where not finite."""
    w = ordered(by)
    s = segments(df, by)
    change = lambda c: (F.col(c) - F.lag(c).over(w)) / F.col("dt")
    clean = lambda c: F.when(finite(c), c).otherwise(0.0)
    return s.select(*by, "seq", *(clean(change(c)).alias(n) for c, n in (("v", "a"), ("vx", "ax"), ("vy", "ay"))))


def positive_intervals(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, seq, dt): times between events that are above zero."""
    return df.withColumn("dt", _diff("time", ordered(by))).where("dt > 0").select(*by, "seq", "dt")


def beyond_zero(df: DataFrame, column: str, guard: float = EPS) -> DataFrame:
    """Rows whose value is off zero by more than ``guard``."""
    return df.where(F.abs(column) > guard)


def _ends(df: DataFrame, name: str, w) -> DataFrame:
    """First and last value copied from their neighbours."""
    c = F.col(name)
    return df.withColumn(name, F.coalesce(c, F.when(F.lag("seq").over(w).isNull(), F.lead(c).over(w)), F.when(F.lead("seq").over(w).isNull(), F.lag(c).over(w)), F.lit(0.0)))


def curvature(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add kappa from the segments before and after an event; 0 where the path stands still, ends copied."""
    w = ordered(by)
    out = df
    for d in "xy":
        out = out.withColumn(f"_p{d}", _diff(d, w) / F.greatest(_diff("time", w), F.lit(EPS)))
        out = out.withColumn(f"_n{d}", F.lead(f"_p{d}").over(w))
    span = F.greatest(F.lead("time").over(w) - F.lag("time").over(w), F.lit(EPS))
    vx, vy = (0.5 * (F.col(f"_p{d}") + F.col(f"_n{d}")) for d in "xy")
    ax, ay = ((F.col(f"_n{d}") - F.col(f"_p{d}")) / span for d in "xy")
    s = vx * vx + vy * vy
    out = out.withColumn("kappa", F.when(s < EPS, 0.0).when(s.isNotNull(), F.abs(vx * ay - vy * ax) / (F.pow(s, F.lit(1.5)) + EPS)))
    return _ends(out, "kappa", w).drop("_px", "_py", "_nx", "_ny")


def angular_velocity(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add omega: turn of the heading up to the next event over the time, last copied; 0 where the path stands still.

    The first event takes the second's heading, 0 if that one stands still. Only
    sizes of turns are used, so each is wrapped by itself: no running unwrap.
    """
    w = ordered(by)
    out = velocity(df, by, "zero").withColumn("_s", F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))
    first = F.lag("seq").over(w).isNull()
    head = F.atan2("vy", "vx")
    out = out.withColumn("_h", F.when(first, F.when(F.lead("_s").over(w) >= EPS, F.lead(head).over(w)).otherwise(0.0)).otherwise(head))
    turn = F.abs(wrap_angle(F.lead("_h").over(w) - F.col("_h")))
    out = out.withColumn("_o", turn / F.greatest(F.lead("time").over(w) - F.col("time"), F.lit(EPS)))
    out = out.withColumn("_o", F.coalesce("_o", F.lag("_o").over(w), F.lit(0.0)))
    return out.withColumn("omega", F.when(F.col("_s") < EPS, 0.0).otherwise(F.col("_o"))).drop("_h", "_o", "_s")


def node_interval(df: DataFrame, by: Sequence[str], *, last: str = "copy") -> DataFrame:
    """Add dt_next: time to the next event; the last copies the one before, or is null ('drop')."""
    w = ordered(by)
    out = df.withColumn("dt_next", F.lead("time").over(w) - F.col("time"))
    return out if last == "drop" else out.withColumn("dt_next", F.coalesce("dt_next", F.lag("dt_next").over(w), F.lit(0.0)))


def pair_differences(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, window_id, i, j, d): absolute differences of ``value`` of all pairs i < j inside each window."""
    keys = [*by, "window_id"]
    a = df.select(*keys, F.col("pos").alias("i"), F.col(value).alias("_a"))
    b = df.select(*keys, F.col("pos").alias("j"), F.col(value).alias("_b"))
    return a.join(b, keys).where("i < j").select(*keys, "i", "j", F.abs(F.col("_b") - F.col("_a")).alias("d"))
