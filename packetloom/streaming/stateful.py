"""Custom state: first-write tumbling counters, first-seen ranks, pending findings with a deadline.

Built on transformWithStateInPandas; state lives in RocksDB and is checkpointed, so a lost executor
resumes from the last committed batch. Timers and times are event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, _parse_datatype_string

STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _ms(t) -> int:
    return int(pd.Timestamp(t).timestamp() * 1000)


class FirstWriteCounter(StatefulProcessor):
    """Counts a key's events in a window that opens at its first event and is never extended; emits once at the threshold. A window that has ended is forgotten."""

    def __init__(self, seconds: int, least: int):
        self.ms, self.least = seconds * 1000, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("count", "opened long, n long, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        opened, n, told = self.state.get() if self.state.exists() else (None, 0, False)
        out = []
        for t in sorted(_ms(x) for f in rows for x in f["event_time"]):
            if opened is None or t >= opened + self.ms:
                opened, n, told = t, 0, False
                self.handle.registerTimer(opened + self.ms)
            if t >= opened:
                n += 1
            if n >= self.least and not told:
                told = True
                out.append((*key, pd.Timestamp(opened, unit="ms"), n))
        if opened is not None:
            self.state.update((opened, n, told))
        yield pd.DataFrame(out, columns=["key", "window_start", "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and self.state.get()[0] + self.ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        yield pd.DataFrame([], columns=["key", "window_start", "n"])

    def close(self) -> None:
        pass


class FirstSeen(StatefulProcessor):
    """Members in the order a key first met them; emits those after the first ``history``, with their rank (from 0).

    With ``keep``, a key without rows for that many seconds is forgotten with all its members, and starts anew.
    """

    def __init__(self, history: int, keep: int | None = None):
        self.history, self.keep = history, keep and keep * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seen long")
        self.known = handle.getMapState("known", "member string", "first_seen long")
        self.size = handle.getValueState("size", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = self.size.get()[0] if self.size.exists() else 0
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for t, member in sorted((_ms(t), m) for f in rows for t, m in zip(f["event_time"], f["member"], strict=True) if m):
            if self.keep and last is not None and t >= last + self.keep:
                self.known.clear()
                n = 0
            last = t if last is None else max(last, t)
            if not self.known.containsKey((member,)):
                self.known.updateValue((member,), (t,))
                if n >= self.history:
                    out.append((*key, member, pd.Timestamp(t, unit="ms"), n))
                n += 1
        self.size.update((n,))
        if last is not None:
            self.last.update((last,))
            if self.keep:
                self.handle.registerTimer(last + self.keep)
        yield pd.DataFrame(out, columns=["key", "member", "first_seen", "rank"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.keep and self.last.exists() and self.last.get()[0] + self.keep <= expiredTimerInfo.getExpiryTimeInMs():
            for state in (self.known, self.size, self.last):
                state.clear()
        yield pd.DataFrame([], columns=["key", "member", "first_seen", "rank"])

    def close(self) -> None:
        pass


class Pending(StatefulProcessor):
    """Candidates wait for their enrichment: a result in time finalises them, the deadline does so without, and a late result gives a new revision.

    Rows have kind candidate or result. Emitted: key, revision, outcome (enriched, timeout or reopened). A finding is
    forgotten ``keep`` seconds after its deadline.
    """

    def __init__(self, seconds: int, keep: int):
        self.ms, self.keep = seconds * 1000, keep * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("finding", "deadline long, revision int, done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        deadline, revision, done = self.state.get() if self.state.exists() else (None, 0, False)
        out = []
        for t, kind in sorted((_ms(t), k) for f in rows for t, k in zip(f["event_time"], f["kind"], strict=True)):
            if kind == "candidate" and deadline is None:
                deadline, revision = t + self.ms, 1
                self.handle.registerTimer(deadline)
            elif kind == "result" and deadline is not None:
                revision += 1
                out.append((*key, revision, "reopened" if done else "enriched"))
                done = True
        if deadline is not None:
            self.state.update((deadline, revision, done))
        yield pd.DataFrame(out, columns=["key", "revision", "outcome"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            deadline, revision, done = self.state.get()
            if expiredTimerInfo.getExpiryTimeInMs() > deadline:
                self.state.clear()
            else:
                out = [] if done else [(*key, revision + 1, "timeout")]
                self.state.update((deadline, revision + (not done), True))
                self.handle.registerTimer(deadline + self.keep)
        yield pd.DataFrame(out, columns=["key", "revision", "outcome"])

    def close(self) -> None:
        pass


class LiveMembers(StatefulProcessor):
    """How many members of a key are live after each batch's last row.

    With ``refresh`` the key as a whole lives for ``seconds`` after its last row, and all members with it; without,
    each member ages by itself, from its own last row.
    """

    def __init__(self, seconds: int, refresh: bool):
        self.ms, self.refresh = seconds * 1000, refresh

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "member string", "seen long")
        self.last = handle.getValueState("last", "seen long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        for t, member in sorted((_ms(t), m) for f in rows for t, m in zip(f["event_time"], f["member"], strict=True) if m):
            if self.refresh and last is not None and t > last + self.ms:
                for m in list(self.known.keys()):
                    self.known.removeKey(m)
            last = t if last is None else max(last, t)
            self.known.updateValue((member,), (t,))
        n = 0
        if last is not None:
            for m, (seen,) in list(self.known.iterator()):
                if not self.refresh and seen + self.ms < last:
                    self.known.removeKey(m)
                else:
                    n += 1
            self.last.update((last,))
            self.handle.registerTimer(last + self.ms + 1)
        yield pd.DataFrame([(*key, pd.Timestamp(last, unit="ms"), n)] if n else [], columns=["key", "event_time", "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and self.last.get()[0] + self.ms < expiredTimerInfo.getExpiryTimeInMs():
            self.known.clear()
            self.last.clear()
        yield pd.DataFrame([], columns=["key", "event_time", "n"])

    def close(self) -> None:
        pass


class SetOnce(StatefulProcessor):
    """The first value written for a key holds for ``seconds`` from then; later writes neither replace it nor extend its life."""

    def __init__(self, seconds: int):
        self.ms = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("written", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, out = self.state.get()[0] if self.state.exists() else None, []
        for t, value in sorted((_ms(t), v) for f in rows for t, v in zip(f["event_time"], f["value"], strict=True)):
            if at is None or t >= at + self.ms:
                at = t
                out.append((*key, value, pd.Timestamp(t, unit="ms")))
        if out:
            self.state.update((at,))
            self.handle.registerTimer(at + self.ms)
        yield pd.DataFrame(out, columns=["key", "value", "written"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and self.state.get()[0] + self.ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        yield pd.DataFrame([], columns=["key", "value", "written"])

    def close(self) -> None:
        pass


def _run(events: DataFrame, processor: StatefulProcessor, schema: str, lateness: str) -> DataFrame:
    rows = events.withColumn("event_time", F.col("event_time").cast("timestamp")).withWatermark("event_time", lateness)
    shape: StructType = _parse_datatype_string(schema)
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=shape, outputMode="Append", timeMode="EventTime")


def first_write_counts(events: DataFrame, seconds: int, least: int, lateness: str = "60 seconds") -> DataFrame:
    """events: key, event_time. See FirstWriteCounter."""
    return _run(events, FirstWriteCounter(seconds, least), "key string, window_start timestamp, n long", lateness)


def first_seen_ranks(events: DataFrame, history: int, lateness: str = "60 seconds", keep: int | None = None) -> DataFrame:
    """events: key, member, event_time. See FirstSeen."""
    return _run(events, FirstSeen(history, keep), "key string, member string, first_seen timestamp, rank long", lateness)


def pending_findings(events: DataFrame, seconds: int, lateness: str = "60 seconds", keep: int = 86_400) -> DataFrame:
    """events: key, kind, event_time. See Pending."""
    return _run(events, Pending(seconds, keep), "key string, revision int, outcome string", lateness)


def live_members(events: DataFrame, seconds: int, refresh: bool, lateness: str = "60 seconds") -> DataFrame:
    """events: key, member, event_time. See LiveMembers."""
    return _run(events, LiveMembers(seconds, refresh), "key string, event_time timestamp, n long", lateness)


def set_once(events: DataFrame, seconds: int, lateness: str = "60 seconds") -> DataFrame:
    """events: key, value, event_time. See SetOnce."""
    return _run(events, SetOnce(seconds), "key string, value string, written timestamp", lateness)
