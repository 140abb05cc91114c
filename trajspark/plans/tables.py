"""The driver's tables read as trajectories.

A user of ``events`` is a session: ordered by (ts, event_id), time in seconds,
x the value, y the number in props, kind the event type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajspark import shared

KEY = ["user_id"]
GAP = 28_800.0
#: Events that a task has, about: their pairs are many times as many.
EVENTS = 1 << 16
SIZE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = shared.dealt(table(spark, sf_dir, "events"), KEY, EVENTS)
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return ev.select(
        "user_id",
        "event_id",
        (F.row_number().over(order).cast("long") - 1).alias("seq"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("time"),
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"),
        F.col("event_type").alias("kind"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores in [0, 1) per event: target and session are groups of users, purchases are genuine."""
    ev = table(spark, sf_dir, "events")
    return ev.select((F.col("user_id") % 4).alias("target"), F.col("user_id").alias("session"), "event_id", F.round(F.col("value") / (F.abs("value") + 50), 3).alias("score"), (F.col("event_type") == "purchase").cast("long").alias("label"))


SQL_EVENTS = """ev AS (SELECT user_id, event_id, event_type AS kind, epoch_us(ts) / 1e6 AS t, value AS x, CAST(regexp_extract(props, '-?[0-9]+') AS DOUBLE) AS y,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, count(*) OVER (PARTITION BY user_id) AS n FROM events)"""
SQL_SCORES = """sc AS (SELECT user_id % 4 AS target, user_id AS session, event_id, round(value / (abs(value) + 50), 3) AS score, CAST(event_type = 'purchase' AS BIGINT) AS label FROM events)"""
