"""Trailing windows over pairs as a stream: each record is kept once, and evaluated at every slide.

A window of ten minutes that slides by thirty seconds holds a record twenty times over if every window has its own
state. Here a pair keeps its records (one a flow and time) until they have left the window, and timers stand at the
ends of the slides at which the pair has something to say: the first after a record came, and the next while any is
left. A timer fires when the watermark has passed it, so all records before it are there; what is told does not depend
on how rows fall into batches, and equals the batch operators over the same windows.

Scores and thresholds stay expressions: an evaluation is a row, and what detectors make of it are columns over it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import stats
from ..operators import flows as batch

WIDTH, SLIDE = 600, 30
FEATURES = "window_end timestamp, times array<double>, sizes array<double>, n_rows long, total double, n_flows long, n_material long, age double"
NAMES = [f.split()[0] for f in FEATURES.split(", ")]


class TrailingFlows(StatefulProcessor):
    """Rows: flow, event_time, size, volume, age. Records of a flow that agree in time are one, the largest."""

    def __init__(self, keys: list[str], width: int, slide: int, material: float):
        if slide <= 0 or width % slide:
            raise ValueError("the window must be a whole number of slides")
        self.keys, self.width, self.slide, self.material = keys, width * 1000, slide * 1000, material

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.records = handle.getMapState("records", "at long, flow string", "size double, volume double, age double")
        self.done = handle.getValueState("done", "upto long")

    def _out(self, rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*self.keys, *NAMES])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: dict[tuple, tuple] = {}
        for f in rows:
            micros = f["event_time"].to_numpy("datetime64[us]").astype("int64")
            for at, flow, *values in zip(micros.tolist(), f["flow"].tolist(), f["size"].tolist(), f["volume"].tolist(), f["age"].tolist(), strict=True):
                values = tuple(values)
                new[at, flow] = max(values, new.get((at, flow), values))
        for place, values in new.items():
            if self.records.containsKey(place):
                values = max(values, tuple(self.records.getValue(place)))
            self.records.updateValue(place, values)
        for slot in {at // 1000 // self.slide for at, _ in new}:
            self.handle.registerTimer((slot + 1) * self.slide)
        yield self._out([])

    def features(self, records: list[tuple]) -> tuple:
        """What detectors need of the records (at, flow, size, volume, age) of a window."""
        points = sorted({(at, size) for at, _, size, _, _ in records})
        volume, age = {}, {}
        for at, flow, _, v, a in records:
            volume[flow] = max(volume.get(flow, (at, v)), (at, v))
            age[flow] = max(age.get(flow, (at, a)), (at, a))
        last = [v for _, v in volume.values()]
        return (
            [at / 1e6 for at, _ in points], [s for _, s in points], len(records), float(sum(last)), len(last),
            sum(v >= self.material for v in last), float(sum(a for _, a in age.values())),
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end, out = expiredTimerInfo.getExpiryTimeInMs(), []
        if not self.done.exists() or end > self.done.get()[0]:
            now = timerValues.getCurrentWatermarkInMs()
            known = sorted((*place, *values) for place, values in self.records.iterator())
            while end <= now:
                inside = [r for r in known if (end - self.width) * 1000 <= r[0] < end * 1000]
                if not inside:
                    break  # what comes later has a timer of its own
                out.append((*key, pd.Timestamp(end, unit="ms"), *self.features(inside)))
                end += self.slide
            left = [r for r in known if r[0] >= (end - self.width) * 1000]
            for r in known[: len(known) - len(left)]:
                self.records.removeKey(r[:2])
            if left:
                self.done.update((end - self.slide,))
                if left[0][0] < end * 1000:
                    self.handle.registerTimer(end)
            else:
                self.done.clear()
        yield self._out(out)

    def close(self) -> None:
        pass


def evaluations(
    flows: DataFrame, key: list[str], identity: list[str], ts: str = "event_time", size: str | None = None, volume: str | None = None, age: str | None = None, width: int = WIDTH, slide: int = SLIDE,
    material: float = 100_000, lateness: str = "60 seconds",
) -> DataFrame:
    """One row a pair and slide at which its window holds records: ``key`` (as text) and FEATURES.

    total and age add up the last value of each flow; n_material of these are at least ``material``. A null size,
    volume or age counts as 0; rows without a time are left out. Needs the state store of ``stateful.STATE``.
    """
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c else F.lit(0.0)
    flow = F.to_json(F.struct(*identity), {"ignoreNullFields": "false"})
    rows = flows.filter(F.col(ts).isNotNull()).select(
        *[F.col(k).cast("string").alias(k) for k in key], flow.alias("flow"), F.col(ts).cast("timestamp").alias("event_time"), value(size).alias("size"), value(volume).alias("volume"), value(age).alias("age")
    )
    shape = ", ".join([*(f"`{k}` string" for k in key), FEATURES])
    return rows.withWatermark("event_time", lateness).groupBy(*key).transformWithStateInPandas(TrailingFlows(key, width, slide, material), outputStructType=shape, outputMode="Append", timeMode="EventTime")


def _score(sized: bool, min_conns: int) -> tuple[Column, Column]:
    """How many records a beacon is judged by, and its score. Without sizes, records of one time are one."""
    times = F.col("times") if sized else F.array_distinct("times")
    return F.size(times), stats.beacon_score(times, F.col("sizes") if sized else None, min_conns)


def beacons(found: DataFrame, min_conns: int = 6, threshold: float = 0.8, sized: bool = False) -> DataFrame:
    """``found`` (evaluations) with n_conns, score and is_beacon; those with too few records go."""
    n, score = _score(sized, min_conns)
    return found.filter(n >= min_conns).withColumns({"n_conns": n, "score": score}).withColumn("is_beacon", F.col("score") >= threshold)


def strobes(found: DataFrame, min_conns: int = 90, threshold: float = 0.8, sized: bool = False) -> DataFrame:
    """Evaluations with at least ``min_conns`` records that are no beacon."""
    many = found.filter(F.col("n_rows") >= min_conns)
    return many.filter(~F.coalesce(_score(sized, 6)[1] >= threshold, F.lit(False))).withColumn("score", stats.capped(F.col("n_rows"), min_conns * 4.0))


def exfil(found: DataFrame, **how) -> DataFrame:
    """Evaluations whose volume is over a threshold at once, or over a lower one by many flows."""
    return batch.exfil(found, **how)


def long_connections(found: DataFrame, **how) -> DataFrame:
    """Evaluations whose flows' ages add up to the threshold."""
    return batch.cumulative_connections(found.drop("total").withColumnRenamed("age", "total"), **how)
