"""Paced replay: the schedule against brute force, and equal batches under a manual clock."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from packetloom.sources import replay

T0 = dt.datetime(2024, 1, 1)


def recorded(spark, seed, n=200):
    r = random.Random(seed)
    micros = sorted(r.choice([r.randrange(10_000_000), r.randrange(9_000_000_000)]) for _ in range(n))
    rows = [(i, T0 + dt.timedelta(microseconds=m)) for i, m in enumerate(micros)] + [(n, T0 + dt.timedelta(microseconds=micros[-1])), (n + 1, None)]
    return spark.createDataFrame(rows, "id long, event_time timestamp"), rows


def expected(rows, speed, max_gap):
    times = sorted({t for _, t in rows if t})
    run, at = 0, {}
    for i, t in enumerate(times):
        gap = (t - times[i - 1]) // dt.timedelta(microseconds=1) if i else 0
        run += gap if max_gap is None else min(gap, int(max_gap * 1_000_000))
        at[t] = int(run / speed // 1)
    return {i: at.get(t) for i, t in rows}


@pytest.mark.parametrize("speed,max_gap,block", [(1.0, None, 3600), (4.0, None, 3600), (1.0, 5.0, 3600), (3.0, 0.5, 60), (1.0, 0.0, 600), (0.5, 1e6, 1)])
def test_due_equals_brute_force(spark, speed, max_gap, block):
    df, rows = recorded(spark, 7)
    got = replay.due(df, speed=speed, max_gap=max_gap, block=block)
    assert got.columns == ["event_time", "id", "due"] or got.columns == ["id", "event_time", "due"]
    assert {r.id: r.due for r in got.collect()} == expected(rows, speed, max_gap)


def test_bounds_and_empty_tables(spark):
    df, _ = recorded(spark, 1, 1)
    for bad in ({"speed": 0}, {"max_gap": -1.0}):
        with pytest.raises(ValueError):
            replay.due(df, **bad)
    for how in ({}, {"max_gap": 1.0}):
        assert replay.due(df.limit(0), **how).count() == 0
        assert replay.due(df.filter("event_time IS NULL"), **how).collect()[0].due is None
    with pytest.raises(ValueError):
        replay.wall_clock(spark, 0.3)


def test_a_manual_clock_gives_equal_batches(spark, tmp_path):
    rows = [(i, T0 + dt.timedelta(seconds=s)) for i, s in enumerate([0, 0.2, 1, 1.9, 2, 5, 5.5])]
    df = spark.createDataFrame(rows, "id long, event_time timestamp")
    replay.stage(replay.due(df), str(tmp_path / "staged"))

    def run(name, stop):
        got = {}
        q = replay.paced(replay.manual_clock(spark, 2), str(tmp_path / "staged")).writeStream.option("checkpointLocation", str(tmp_path / name))
        q = q.foreachBatch(lambda b, n: got.__setitem__(n, sorted(r.id for r in b.collect()))).start()
        while not q.exception() and (not got or max(got) < stop):
            q.awaitTermination(1)
        q.stop()
        return got

    first = run("a", 2)
    assert [first[n] for n in range(3)] == [[0, 1, 2, 3], [4], [5, 6]]
    # a stopped replay goes on with the next ticks, or repeats a batch as it was
    more = run("a", max(first) + 1)
    assert min(more) >= max(first) and all(more[n] == first[n] for n in more if n in first)
    assert replay.paced(spark.range(5, 6, 1, 1).toDF("value"), str(tmp_path / "staged")).select(F.sort_array(F.collect_list("id"))).collect()[0][0] == [5, 6]
