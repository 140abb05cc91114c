"""Queries that run streams over the events table: it arrives in parts, out of order, in runs that go on from each other.

Each compares with the SQL of the whole table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark import shared
from trajspark.plans.tables import GAP, table, trajectories
from trajspark.streaming import ordered, sinks

PARTS = 3
#: Length at which merged groups are whole.
LEAST = 150.0
#: A group that stays short is given up after so many seconds; longer than the events last.
EXPIRE = 86_400.0 * 4_000


def replay(spark: SparkSession, sf_dir: str, build: Callable[[DataFrame, str], DataFrame], keys: Sequence[str] = (), *, twice: bool = False) -> DataFrame:
    """What ``build(stream, lateness)`` has written once all events have come in ``PARTS`` runs.

    Every fourth event comes a run late, within the lateness; with ``twice``, every fifth
    comes again a run later. The last run ends with an event long after the others.
    """
    base = shared.new_path(spark, "stream")
    ts = F.col("ts").cast("timestamp")
    events = trajectories(spark, sf_dir).select("user_id", "event_id", "x", "y").join(table(spark, sf_dir, "events").select("event_id", ts.alias("ts")), "event_id")
    lo, hi = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    lo, hi = lo or 0, hi or 0
    own = F.floor((F.unix_micros("ts") - lo) * PARTS / (hi - lo + 1)) + (F.col("event_id") % 4 == 0).cast("long")
    own = F.least(own, F.lit(PARTS - 1))
    runs = F.array(own, F.least(own + 1, F.lit(PARTS - 1))) if twice else F.array(own)
    runs = F.when(F.col("event_id") % 5 == 0, runs).otherwise(F.array(own)) if twice else runs
    dealt = shared.written(events.withColumn("run", F.explode(runs)), f"{base}/dealt")
    schema = dealt.drop("run").schema
    for run in range(PARTS):
        part = dealt.where(F.col("run") == run).drop("run")
        if run == PARTS - 1:
            end = spark.range(1).select(F.lit(None), F.lit(None), F.lit(0.0), F.lit(0.0), F.timestamp_micros(F.lit(hi + 2 * int(EXPIRE * 1e6))))
            part = part.select(*schema.names).union(end.toDF("user_id", "event_id", "x", "y", "ts").select(*schema.names))
        part.write.mode("append").parquet(f"{base}/in")
        out = build(spark.readStream.schema(schema).parquet(f"{base}/in"), f"{math.ceil((hi - lo) / 1e6 / 2) + 1} seconds")
        sinks.run_to_end(out, f"{base}/out", f"{base}/checkpoint", keys)
    found = sinks.read_once(spark, f"{base}/out", out.schema)
    for used in ("dealt", "in", "checkpoint"):
        shared.delete(spark, f"{base}/{used}")
    return found.where("user_id IS NOT NULL")


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap-split sequences merged up to LEAST, from the stream."""
    return replay(spark, sf_dir, lambda stream, lateness: ordered.merge(stream, GAP, LEAST, lateness, expire=EXPIRE))


def windows(spark: SparkSession, sf_dir: str, size: int, stride: int) -> DataFrame:
    """Sliding count windows, from the stream."""
    return replay(spark, sf_dir, lambda stream, lateness: ordered.count_windows(stream, size, lateness, stride, value="x"))


def once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written exactly once, though some come twice and the stream stops in between."""
    return replay(spark, sf_dir, lambda stream, _: stream, ["event_id"], twice=True)
