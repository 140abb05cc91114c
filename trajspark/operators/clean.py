"""Cleaning of raw session logs into events (keys, seq, time, x, y, kind)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Profile:
    """How a dataset names its columns and which rows are moves."""

    time: tuple[str, ...]
    x: str
    y: str
    kind: str
    keep: str
    fold_headers: bool = False
    kind_optional: bool = False
    per_second: float = 1.0


# Column names, kept kinds and time units of the supported datasets.
PROFILES = {
    "balabit": Profile(("client timestamp",), "x", "y", "state", "Move"),
    "chaoshen": Profile(("Timestamp",), "X", "Y", "EventName", "Move", per_second=1000.0),
    "dfl": Profile(("client timestamp", "timestamp"), "x", "y", "state", "move", fold_headers=True, kind_optional=True, per_second=1000.0),
    "twos": Profile(("timestamp",), "x", "y", "event", "Mouse Moved"),
}


def profile(dataset: str) -> Profile:
    if dataset not in PROFILES:
        raise ValueError(f"unknown dataset {dataset!r}; known: {sorted(PROFILES)}")
    return PROFILES[dataset]


def first_occurrences(df: DataFrame, keys: Sequence[str], columns: Sequence[str], seq: str = "seq") -> DataFrame:
    """One row of each group of rows alike in keys and columns: the earliest, in its place."""
    return df.groupBy(*(f"`{c}`" for c in [*keys, *columns])).agg(F.min(seq).alias(seq))


def clean(df: DataFrame, dataset: str, keys: Sequence[str], *, max_coord: float | None = 65535, dedup: bool = True, kind_filter: bool = True, dedup_first: bool = False, milliseconds: bool = False) -> DataFrame:
    """(keys, seq, time, x, y, kind) of the moves, numeric and inside the bound.

    df has keys, seq and the columns of the log; all of the latter decide what is
    a duplicate. Rows whose time or coordinates aren't numbers are dropped. Times keep
    the log's unit; ``milliseconds`` brings those in seconds to milliseconds.
    """
    p = profile(dataset)
    raw = [c for c in df.columns if c not in (*keys, "seq")]
    if p.fold_headers:
        df = df.select(*keys, "seq", *(F.col(f"`{c}`").alias(c.strip().lower()) for c in raw))
        raw = [c.strip().lower() for c in raw]
    time = next((c for c in p.time if c in raw), None)
    if time is None:
        raise ValueError(f"{dataset}: none of the time columns {p.time} is there")
    number = lambda c: F.col(f"`{c}`").cast("string").try_cast("double")
    if dedup and dedup_first:
        df = first_occurrences(df, keys, raw)
    if kind_filter and (p.kind in raw or not p.kind_optional):
        kind = F.lower(F.col(f"`{p.kind}`")) if p.fold_headers else F.col(f"`{p.kind}`")
        df = df.where(kind == p.keep)
    if max_coord is not None:
        df = df.where((number(p.x) < max_coord) & (number(p.y) < max_coord))
    if dedup and not dedup_first:
        df = first_occurrences(df, keys, raw)
    kind = F.col(f"`{p.kind}`") if p.kind in raw else F.lit(None).cast("string")
    return df.select(*keys, "seq", (number(time) * (1000.0 / p.per_second if milliseconds else 1.0)).alias("time"), number(p.x).alias("x"), number(p.y).alias("y"), kind.alias("kind")).dropna(subset=["time", "x", "y"])


def single_precision_time(df: DataFrame) -> DataFrame:
    """Times rounded to 32 bits, as array-based encodings see them."""
    return df.withColumn("time", F.col("time").cast("float").cast("double"))


def renumber(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """seq as 0, 1, 2, ... in each session, in order."""
    from pyspark.sql import Window

    return df.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy("seq")).cast("long") - 1)
