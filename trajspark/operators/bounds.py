"""Bounds of users, sessions and splits, their lookup, and standard screens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest pixel indices assumed for users without training data.
DEFAULT_MAX = (1919.0, 1079.0)
# Standard screens (width, height).
SCREENS = ((3840, 2160), (2560, 1440), (1920, 1200), (1920, 1080), (1680, 1050), (1600, 900), (1440, 900), (1366, 768), (1280, 1024), (1280, 800), (1280, 720), (1024, 768))


def user_bounds(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """min_x, min_y, max_x, max_y, diag per key; largest values start from 0."""
    high = lambda c: F.greatest(F.max(c), F.lit(0.0))
    out = df.groupBy(*by).agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), high("x").alias("max_x"), high("y").alias("max_y"))
    w, h = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    return out.withColumn("diag", F.sqrt(w * w + h * h))


def with_bounds(df: DataFrame, bounds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left join; keys without bounds take the defaults. Spark broadcasts bounds where its size limit allows."""
    out = df.join(bounds, list(by), "left")
    filled = {"min_x": 0.0, "min_y": 0.0, "max_x": DEFAULT_MAX[0], "max_y": DEFAULT_MAX[1]}
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in filled.items()})


def shifted(df: DataFrame) -> DataFrame:
    """Coordinates from the user's least values."""
    return df.withColumns({"x": F.col("x") - F.col("min_x"), "y": F.col("y") - F.col("min_y")})


def normalised(df: DataFrame, guard: float = 1e-8) -> DataFrame:
    """Coordinates scaled to [0, 1] by the extent of the whole frame."""
    ends = df.agg(*(f(c).alias(f"_{n}{c}") for c in "xy" for f, n in ((F.min, "lo"), (F.max, "hi"))))
    out = df.crossJoin(F.broadcast(ends))
    return out.withColumns({c: (F.col(c) - F.col(f"_lo{c}")) / F.greatest(F.col(f"_hi{c}") - F.col(f"_lo{c}"), F.lit(guard)) for c in "xy"}).drop("_lox", "_hix", "_loy", "_hiy")


def standard_resolution(df: DataFrame, max_x: str = "max_x", max_y: str = "max_y") -> DataFrame:
    """Add norm_width, norm_height: the smallest screen that holds the maxima, else the nearest one (as largest indices)."""
    x, y = F.col(max_x).cast("double"), F.col(max_y).cast("double")
    screens = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(w - 1.0).alias("w"), F.lit(h - 1.0).alias("h"), F.lit(w * h).alias("area")) for i, (w, h) in enumerate(SCREENS)))
    fits = F.array_min(F.transform(F.filter(screens, lambda s: (s["w"] >= x) & (s["h"] >= y)), lambda s: F.struct(s["area"].cast("double").alias("cost"), s["i"], s["w"], s["h"])))
    over = lambda a, b: F.pow(F.greatest(a - b, F.lit(0.0)), F.lit(2))
    near = F.array_min(F.transform(screens, lambda s: F.struct((over(x, s["w"]) + over(y, s["h"])).alias("cost"), s["i"], s["w"], s["h"])))
    chosen = F.coalesce(fits, near)
    return df.withColumns({"norm_width": chosen["w"], "norm_height": chosen["h"]})
