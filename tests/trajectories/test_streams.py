"""Ordered state and exactly-once sinks: streams equal tables, whatever the batches."""

import pytest
from pyspark.sql import functions as F

from trajspark.operators import sequence
from trajspark.streaming import ordered, sinks

GAP, LEAST = 100.0, 50.0


def arrive(spark, rows, path):
    """Append (user_id, event_id, seconds, x) as one file of events."""
    df = spark.createDataFrame(rows, "user_id long, event_id long, s double, x double").select("user_id", "event_id", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"), "x", F.lit(0.0).alias("y"))
    df.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def events():
    """Two users, steps of 10 in x, gaps at every third event of user 1 and every fifth of user 2."""
    out = []
    for user, every in ((1, 3), (2, 5)):
        t = 1_000.0
        for k in range(20):
            t += 500 if k % every == 0 else 20
            out.append((user, user * 100 + k, t, 10.0 * k))
    return sorted(out, key=lambda e: e[2])


def as_table(spark):
    df = spark.createDataFrame(events(), "user_id long, event_id long, time double, x double").withColumn("y", F.lit(0.0))
    return df.withColumn("seq", F.expr("row_number() OVER (PARTITION BY user_id ORDER BY time, event_id) - 1"))


LAST = (3, 999, 1e9, 0.0)


def run_parts(spark, tmp_path, parts, build, keys=()):
    path = str(tmp_path / "in")
    for rows in parts:
        schema = arrive(spark, rows, path)
        out = build(spark.readStream.schema(schema).parquet(path))
        sinks.run_to_end(out, str(tmp_path / "out"), str(tmp_path / "checkpoint"), keys)
    return sinks.read_once(spark, str(tmp_path / "out"), out.schema)


def jumbled(n):
    """The events in n parts, neighbours out of order inside and between them."""
    own = events()
    size = -(-len(own) // n)
    parts = [own[i : i + size] for i in range(0, len(own), size)]
    for a, b in zip(parts, parts[1:], strict=False):
        a[-1], b[0] = b[0], a[-1]
    return [p[::-1] for p in parts]


@pytest.mark.parametrize("n", [1, 3])
def test_merge_equals_the_table(spark, tmp_path, n):
    parts = jumbled(n)
    parts[-1] = [*parts[-1], LAST]
    got = run_parts(spark, tmp_path, parts, lambda s: ordered.merge(s, GAP, LEAST, "1000 seconds", expire=1e6))
    table = sequence.greedy_merge(sequence.gap_split(as_table(spark), ["user_id"], GAP), ["user_id"], F.max(F.lit(LEAST)))
    want = {tuple(r) for r in table.groupBy("user_id", "group_id").agg(F.count("*"), F.max("x") - F.min("x")).collect()}
    assert {(r.user_id, r.group_id, r.n, r.length) for r in got.collect()} == want
    assert all(r.whole == (r.length >= LEAST) for r in got.collect())


def test_groups_are_emitted_by_timer_and_late_events_dropped(spark, tmp_path):
    first = [(1, 1, 1_000.0, 0.0), (1, 2, 1_010.0, 60.0), (2, 3, 1_000.0, 0.0), (3, 4, 2_000.0, 0.0)]
    late = [(1, 5, 1_005.0, 500.0), (3, 6, 2_001.0, 1.0)]
    build = lambda s: ordered.merge(s, GAP, LEAST, "10 seconds")
    got = run_parts(spark, tmp_path, [first], build)
    assert [(r.user_id, r.n, r.length, r.whole) for r in got.collect()] == [(1, 2, 60.0, True)]  # user 2 stays short and waits
    got = run_parts(spark, tmp_path, [late, [LAST]], build)
    assert [(r.user_id, r.n) for r in got.collect()] == [(1, 2)]


def test_expired_groups_begin_anew(spark, tmp_path):
    rows = [(1, 1, 1_000.0, 0.0), (1, 2, 9_000.0, 1.0), LAST]
    got = run_parts(spark, tmp_path, [rows[:1], [(5, 7, 8_000.0, 0.0)], rows[1:]], lambda s: ordered.merge(s, GAP, LEAST, "1 seconds", expire=500.0))
    assert sorted((r.user_id, r.group_id, r.n, r.whole) for r in got.where("user_id = 1").collect()) == [(1, 0, 1, False), (1, 1, 1, False)]


@pytest.mark.parametrize("n,size,stride", [(3, 4, 1), (2, 4, 4), (3, 3, 5)])
def test_count_windows_equal_the_table(spark, tmp_path, n, size, stride):
    parts = jumbled(n)
    parts[-1] = [*parts[-1], LAST]
    got = run_parts(spark, tmp_path, parts, lambda s: ordered.count_windows(s, size, "1000 seconds", stride, value="x"))
    want = sequence.sliding(as_table(spark), ["user_id"], size, stride).groupBy("user_id", "window_id").agg(F.avg("x"), F.max("time"))
    assert {(r.user_id, r.window_id, r.mean, r.end.timestamp()) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_a_broken_run_leaves_what_one_run_leaves(spark, tmp_path, monkeypatch):
    whole, calls = sinks.write_once, []

    def breaks(rows, batch, *rest):
        whole(rows, batch, *rest)
        calls.append(batch)
        if len(calls) == 2:
            raise RuntimeError("lost after the table was written, before the batch was committed")

    monkeypatch.setattr(sinks, "write_once", breaks)
    parts = [[(1, i, float(i), 1.0) for i in range(k, k + 5)] for k in (0, 4, 8)]  # ids 4 and 8 come twice
    run_parts(spark, tmp_path, parts[:1], lambda s: s, ["event_id"])
    with pytest.raises(Exception, match="lost after"):
        run_parts(spark, tmp_path, parts[1:2], lambda s: s, ["event_id"])
    got = run_parts(spark, tmp_path, parts[2:], lambda s: s, ["event_id"])
    assert sorted(r.event_id for r in got.collect()) == list(range(13))
    assert calls[1] == calls[2]  # the same batch again


def test_unfinished_batches_are_not_read(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_once(spark.range(3), 0, path)
    sinks.write_once(spark.range(9), 1, path)
    (tmp_path / "out" / "batch=1" / "_SUCCESS").unlink()
    assert sinks.read_once(spark, path, spark.range(1).schema).count() == 3
    assert sinks.read_once(spark, str(tmp_path / "none"), spark.range(1).schema).count() == 0


def test_one_read_and_one_write_of_the_state_a_call():
    """Each access of a state is a call to the JVM; waiting events and the fold are one value."""
    from types import SimpleNamespace

    from trajspark.streaming.ordered import CountWindows

    calls, held = [], {}

    class State:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, what):
            def call(*value):
                calls.append(what)
                if what in ("update", "put"):
                    held[self.name] = value[0]
                return {"get": held.get(self.name), "exists": self.name in held}.get(what)

            return call

    handle = SimpleNamespace(getValueState=lambda name, schema: State(name), getListState=lambda name, schema: State(name), registerTimer=lambda t: None)
    processor = CountWindows(2, 2)
    processor.key = "user_id"
    processor.init(handle)
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    event = lambda t, i: SimpleNamespace(t=t * 1000, id=i, x=float(i), y=0.0)
    assert list(processor.handleInputRows((1,), iter([event(9, 3), event(1, 1)]), at(0))) == []
    assert calls == ["get", "update"]
    out = list(processor.handleInputRows((1,), iter([event(2, 2)]), at(5)))
    assert [(r.window_id, r.start, r.end, r.mean) for r in out] == [(0, 1000, 2000, 1.5)]
    assert list(processor.handleExpiredTimer((1,), at(6), None)) == [] and calls == ["get", "update"] * 2 + ["get"]
