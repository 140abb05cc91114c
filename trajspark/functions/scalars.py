"""Column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8
MIN_DT = 1e-5


def natural_key(name: Column) -> Column:
    """Sort key that reads digit runs as numbers and folds case: runs become (is_text, number, text)."""
    runs = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(runs, lambda r: F.struct((~r.rlike(r"^\d")).alias("is_text"), r.try_cast("decimal(38,0)").alias("number"), F.lower(r).alias("text")))


def file_stem(path: Column) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def sample_name(name: Column) -> tuple[Column, Column]:
    """(session, start) of names like ``session-240.png``; start is 0 where none can be read."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    start = F.regexp_extract(stem, r"-(\d+)$", 1)
    session = F.when(stem.contains("-"), F.regexp_extract(stem, r"^(.*)-[^-]*$", 1)).otherwise(stem)
    return session, F.coalesce(start.try_cast("int"), F.lit(0))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)


def signed_log(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def wrap_angle(c: Column) -> Column:
    """The angle moved by whole turns into [-pi, pi]."""
    return c - 2 * math.pi * F.rint(c / (2 * math.pi))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def to_byte(c: Column) -> Column:
    """A share of [0, 1] as a whole number up to 255, cut down."""
    return F.least(F.greatest((c * 255).cast("int"), F.lit(0)), F.lit(255))


def min_max(c: Column, low: Column, high: Column, guard: float = EPS) -> Column:
    return (c - low) / F.greatest(high - low, F.lit(guard))


def one_hot(index: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: (k == index).cast("int"))


def image_side(size: int, base: int) -> int:
    """Side of an image that grows with the root of the window size."""
    return int(round(base * math.sqrt(size / base)))
