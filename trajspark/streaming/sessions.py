"""Session windows on streams and tables; count windows and merging are in ``ordered``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gap_sessions(events: DataFrame, gap: str, lateness: str, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """(key, start, end, n) of runs of events whose gaps don't exceed ``gap``; works on streams and tables.

    On a stream, a run is emitted once the watermark, ``lateness`` behind, has passed its end.
    """
    kept = events.withWatermark(ts, lateness) if events.isStreaming else events
    return kept.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")

