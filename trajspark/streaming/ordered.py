"""Ordered state on streams: greedy merging and count windows that equal their table forms.

Events of a key may come in any order within the watermark's lateness. They wait in
the state until the watermark has passed them and are then folded in order of
(time, id), so results don't depend on how the stream is cut into batches. State is
the waiting events (those of the lateness) and one small fold a key, read and written
as one value, as each access is a call to the JVM. Timers wake a
key whose events or gaps the watermark passes while nothing new comes. Events behind
the watermark are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_WAITING = "waiting_t array<long>, waiting_id array<long>, waiting_x array<double>, waiting_y array<double>"


class Ordered(StatefulProcessor):
    """Folds the events of a key in order; subclasses say what the state is and what it emits."""

    #: Schema of the state, its values before the first event, and the schema of the output after the key; start and end in microseconds.
    STATE: str
    START: tuple
    OUTPUT: str
    key: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", f"{self.STATE}, {_WAITING}")
        self.row = Row(self.key, *(field.split()[0] for field in self.OUTPUT.split(", ")))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fresh = [(r.t, r.id, r.x, r.y) for r in rows]
        yield from self._advance(key, fresh, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key, [], timerValues)

    def _advance(self, key, fresh: list[tuple], timer_values) -> Iterator[Row]:
        passed = timer_values.getCurrentWatermarkInMs() * 1000
        held = self.held.get()
        state, waiting = (list(held[:-4]), list(zip(*held[-4:], strict=True))) if held else (list(self.START), [])
        before = list(state)
        events = sorted([*waiting, *fresh])
        ready = [e for e in events if e[0] <= passed]
        rest = events[len(ready) :]
        for event in ready:
            for row in self.fold(state, *event):
                yield self.row(*key, *row)
        for row in self.quiet(state, passed):
            yield self.row(*key, *row)
        if fresh or ready or state != before:
            self.held.update((*state, *(list(c) for c in zip(*rest, strict=True))) if rest else (*state, [], [], [], []))
        wake = [t for t in (rest[0][0] if rest else None, self.deadline(state, passed)) if t is not None]
        if wake:
            self.handle.registerTimer(-(-min(wake) // 1000) + 1)

    def fold(self, state: list, t: int, event_id: int, x: float, y: float) -> Iterator[tuple]:
        """Take an event into the state; gives output rows without the key."""
        raise NotImplementedError

    def quiet(self, state: list, passed: int) -> Iterator[tuple]:
        """Output known once nothing up to ``passed`` can come any more."""
        return iter(())

    def deadline(self, state: list, passed: int) -> int | None:
        """When ``quiet`` has to look again, if no event comes before; later than ``passed``."""
        return None

    def close(self) -> None:
        pass


class MergeGroups(Ordered):
    """Sequences (cut at gaps) joined until their path is long enough; see ``merge``."""

    STATE = "group_id long, n long, start long, last long, x double, y double, length double"
    START = (0, 0, None, None, None, None, 0.0)
    OUTPUT = "group_id long, n long, start long, end long, length double, whole boolean"

    def __init__(self, gap: float, least: float, expire: float | None):
        self.gap, self.least = round(gap * 1e6), least
        self.expire = None if expire is None else max(round(expire * 1e6), self.gap)

    def _out(self, state: list, whole: bool) -> tuple:
        group, n, start, last, *_, length = state
        state[:] = [group + 1, 0, None, last, None, None, 0.0]
        return group, n, start, last, length, whole

    def fold(self, state: list, t: int, event_id: int, x: float, y: float) -> Iterator[tuple]:
        if state[1] and t - state[3] > self.gap and state[6] >= self.least:
            yield self._out(state, True)
        if state[1]:
            state[6] += math.hypot(x - state[4], y - state[5])
        else:
            state[2] = t
        state[1] += 1
        state[3:6] = t, x, y

    def quiet(self, state: list, passed: int) -> Iterator[tuple]:
        if state[1] and passed - state[3] > self.gap and state[6] >= self.least:
            yield self._out(state, True)
        elif state[1] and self.expire is not None and passed - state[3] > self.expire:
            yield self._out(state, False)

    def deadline(self, state: list, passed: int) -> int | None:
        waits = [state[3] + w + 1 for w in (self.gap, self.expire) if state[1] and w is not None]
        return min((w for w in waits if w > passed), default=None)


class CountWindows(Ordered):
    """A ring of the last events; see ``count_windows``."""

    STATE = "n long, t array<long>, x array<double>"
    START = (0, [], [])
    OUTPUT = "window_id long, n int, start long, end long, mean double"

    def __init__(self, size: int, stride: int):
        self.size, self.stride = size, stride

    def fold(self, state: list, t: int, event_id: int, x: float, y: float) -> Iterator[tuple]:
        state[0] += 1
        state[1], state[2] = [*state[1], t][-self.size :], [*state[2], x][-self.size :]
        after = state[0] - self.size
        if after >= 0 and after % self.stride == 0:
            yield after // self.stride, self.size, state[1][0], state[1][-1], sum(state[2]) / self.size


def _folded(events: DataFrame, processor: Ordered, lateness: str, key: str, ts: str, id: str, x: str, y: str | None) -> DataFrame:
    spark = events.sparkSession
    if spark.conf.get(PROVIDER) != ROCKSDB:
        spark.conf.set(PROVIDER, ROCKSDB)  # the only provider with timers and lists
    processor.key = key
    columns = events.withWatermark(ts, lateness).select(key, ts, F.unix_micros(ts).alias("t"), F.col(id).cast("long").alias("id"), F.col(x).cast("double").alias("x"), (F.lit(0.0) if y is None else F.col(y).cast("double")).alias("y"))
    out = columns.groupBy(key).transformWithState(statefulProcessor=processor, outputStructType=f"{key} {events.schema[key].dataType.simpleString()}, {processor.OUTPUT}", outputMode="Append", timeMode="EventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("start", "end")})


def merge(events: DataFrame, gap: float, least: float, lateness: str, *, expire: float | None = None, key: str = "user_id", ts: str = "ts", id: str = "event_id", x: str = "x", y: str = "y") -> DataFrame:
    """(key, group_id, n, start, end, length, whole) of a stream: ``sequence.greedy_merge`` over ``sequence.gap_split``.

    A sequence ends where time moves by more than ``gap`` seconds; sequences join until
    the path from the group's first event is ``least`` long. A group is emitted once
    the watermark shows that its last sequence is over. A group that stays short is
    emitted as not whole ``expire`` seconds after its last event, and a new one begins;
    without ``expire`` it waits.
    """
    return _folded(events, MergeGroups(gap, least, expire), lateness, key, ts, id, x, y)


def count_windows(events: DataFrame, size: int, lateness: str, stride: int | None = None, *, key: str = "user_id", ts: str = "ts", id: str = "event_id", value: str = "value") -> DataFrame:
    """(key, window_id, n, start, end, mean of ``value``) of every ``size`` events of a key, a window every ``stride`` (by default ``size``): ``sequence.sliding`` on a stream."""
    return _folded(events, CountWindows(size, stride or size), lateness, key, ts, id, value, None)
