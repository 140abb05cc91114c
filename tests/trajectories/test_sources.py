"""Ordered logs, stores and streams."""

import os

import pytest
from pyspark.sql import functions as F

from trajspark.operators import sequence
from trajspark.sources import sessions
from trajspark.streaming.sessions import gap_sessions

#: A folder of session logs in the split layout, if there is one.
LOGS = os.environ.get("SESSION_LOGS", "")


@pytest.mark.skipif(not os.path.isdir(LOGS), reason="no session logs here")
def test_counts_of_session_logs(spark):
    events = sessions.load_events(spark, f"{LOGS}/testing_files_protocol1", "balabit").cache()
    by = ["user", "session"]
    assert events.count() == 53_297
    assert sequence.tumbling(events, by, 125).where("pos = 0").count() == 366
    assert sequence.tumbling(events, by, 125, ragged=True).where("pos = 0").count() == 485
    assert sequence.sliding(events, by, 125, 31).where("pos = 0").count() == 1_295
    split = sequence.gap_split(events, by, 1.0)
    assert split.select(*by, "sequence_id").distinct().count() == 1_998
    groups = sequence.greedy_merge(split, by, F.max("x")).groupBy(*by, "group_id").count()
    assert (groups.count(), groups.where("count >= 2").count()) == (871, 869)
    events.unpersist()


def test_logs_keep_file_order(spark, tmp_path):
    for user, name, lines in [("user2", "session_1", ["5,1,Move", "3,2,Move", "3,2,Move", "4,9,Down"]), ("user10", "session_2.csv", ["1,1,Move"]), ("training_files", "session_9", ["1,1,Move"])]:
        os.makedirs(tmp_path / user, exist_ok=True)
        (tmp_path / user / name).write_text("\r\n".join(["client timestamp,x,state,y", *(f"{a.split(',')[0]},{a.split(',')[1]},{a.split(',')[2]},7" for a in lines)]) + "\r\n")
    events = sessions.load_events(spark, str(tmp_path), "balabit")
    assert sorted((r.user, r.session, r.seq, r.time, r.x, r.y) for r in events.collect()) == [("user10", "session_2", 0, 1.0, 1.0, 7.0), ("user2", "session_1", 0, 5.0, 1.0, 7.0), ("user2", "session_1", 1, 3.0, 2.0, 7.0)]
    assert {r.user: r.user_idx for r in sessions.user_index(events).collect()} == {"user2": 0, "user10": 1}


def test_store_resumes(spark, tmp_path):
    df = spark.range(6).select(F.col("id").alias("sample_id"), F.lit("u").alias("user"))
    path = str(tmp_path / "store")
    sessions.write_samples(df.limit(4), path)
    with pytest.raises(Exception, match="already exists"):
        sessions.write_samples(df, path)
    sessions.write_samples(df, path, resume=True)
    assert sorted(r.sample_id for r in sessions.read_samples(spark, path).collect()) == list(range(6))


def test_cached_table(spark, tmp_path):
    path, calls = str(tmp_path / "bounds"), []

    def build():
        calls.append(1)
        return spark.createDataFrame([("u", 3.0)], "user string, max_x double")

    for rescan in (False, False, True):
        assert sessions.cached_table(spark, path, build, rescan=rescan, required=["max_x"]).first().max_x == 3.0
    assert len(calls) == 2
    with pytest.raises(ValueError, match="lacks"):
        sessions.cached_table(spark, path, build, required=["other"])


def test_image_tree(spark, tmp_path):
    os.makedirs(tmp_path / "user1")
    for name in ("session_1-10.png", "session_1-9.png", "other.png"):
        (tmp_path / "user1" / name).write_bytes(b"x")
    assert [(r.session, r.idx) for r in sessions.image_tree(spark, str(tmp_path)).orderBy("session", "idx").collect()] == [("session_1", 9), ("session_1", 10)]


def test_streams_equal_tables(spark, sf, tmp_path):
    ev = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    q = gap_sessions(stream, "8 hours", "40 days").writeStream.format("memory").queryName("gaps").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert gap_sessions(ev, "8 hours", "1 hour").agg(F.sum("n")).first()[0] == ev.count()
    assert gap_sessions(ev, "8 hours", "1 hour").where("end <= start").count() == 0

