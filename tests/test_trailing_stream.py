"""Trailing windows as a stream against the batch operators over the same windows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from packetloom.operators import flows
from packetloom.streaming import stateful, trailing

T0 = dt.datetime(2024, 1, 1)
WIDTH, SLIDE = 120, 30
SCHEMA = "tenant string, src string, flow long, event_time timestamp, size double, bytes double, age double"
KEY = ["tenant", "src"]


@pytest.fixture
def rocks(spark):
    for k, v in stateful.STATE.items():
        spark.conf.set(k, v)
    yield spark
    for k in stateful.STATE:
        spark.conf.unset(k)


def traffic(seed):
    """Regular and irregular pairs, updates of flows, replays, times exactly on a slide, a pause longer than the window."""
    r, rows = random.Random(seed), []
    for i in range(60):
        t = i * 10 + (300 if i > 35 else 0)
        rows.append(("t", "regular", i, t, 100.0, 10.0 * (i % 4), 5.0))
        at = r.choice([r.uniform(0, 900), 30.0 * r.randrange(30)])
        rows.append(("t", f"odd{r.randrange(2)}", r.randrange(12), round(at, 3), float(r.randrange(3)), r.choice([None, 5.0, 500.0]), r.choice([1.0, 40.0])))
    rows.append(("t", "once", 1, 450.0, 1.0, 1.0, 1.0))
    rows = [(*row[:3], T0 + dt.timedelta(seconds=row[3]), *row[4:]) for row in rows]
    return rows + rows[:9]


def streamed(spark, rows, tmp, batches):
    """Rows in event order, in so many batches, then one that moves the watermark beyond all; evaluations, and state rows after each batch."""
    rows = sorted(rows, key=lambda x: x[3])
    src, n = tmp / "in", -(-len(rows) // batches)
    parts = [rows[i : i + n] for i in range(0, len(rows), n)] + [[("t", "end", 1, T0 + dt.timedelta(hours=5), 0.0, 0.0, 0.0)], [("t", "end", 2, T0 + dt.timedelta(hours=9), 0.0, 0.0, 0.0)]]
    sizes = []
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
        got = trailing.evaluations(spark.readStream.schema(SCHEMA).parquet(str(src)), KEY, ["flow"], size="size", volume="bytes", age="age", width=WIDTH, slide=SLIDE, material=100)
        # every batch is a query of its own: state comes from the checkpoint
        q = got.writeStream.format("parquet").option("path", str(tmp / "out")).option("checkpointLocation", str(tmp / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        sizes += [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators][-1:]
    return spark.read.parquet(str(tmp / "out")).filter("src <> 'end'").cache(), sizes


def windowed(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).fillna(0.0, ["bytes"])
    return df.withColumn("w", F.explode(F.transform(F.sequence(F.lit(0), F.lit(WIDTH // SLIDE - 1)), lambda i: F.timestamp_seconds((F.floor(F.unix_micros("event_time") / (SLIDE * 1_000_000)) + 1 + i) * SLIDE))))


def same(a, b, *columns):
    got = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select("src", *columns).collect())
    return got(a), got(b)


@pytest.mark.parametrize("seed,batches", [(1, 1), (1, 4)])
def test_stream_equals_batch_at_every_slide(rocks, tmp_path, seed, batches):
    rows = traffic(seed)
    found, sizes = streamed(rocks, rows, tmp_path, batches)
    whole = windowed(rocks, rows).withColumnRenamed("w", "window_end")
    by = [*KEY, "window_end"]

    a, b = same(found.withColumnRenamed("n_rows", "n"), whole.groupBy(*by).agg(F.count_distinct("flow", "event_time").alias("n")), "window_end", "n")
    assert a == b and len(a) > 60

    for sized in (False, True):
        want = flows.beacons(whole, by, "event_time", "size" if sized else None, min_conns=6)
        got = trailing.beacons(found, 6, sized=sized)
        a, b = same(got, want, "window_end", "n_conns", "score", "is_beacon")
        assert a == b and any(r[-1] for r in a)

    vol = flows.volumes(whole, by, ["flow"], "event_time", "bytes", 100)
    a, b = same(found, vol, "window_end", "total", "n_flows", "n_material")
    assert a == b and any(r[-1] for r in a)
    age = flows.volumes(whole, by, ["flow"], "event_time", "age")
    a, b = same(trailing.long_connections(found, threshold=60, min_conns=2), flows.cumulative_connections(age, 60, 2), "window_end", "total", "score")
    assert a == b and a
    a, b = same(trailing.exfil(found, threshold=900, low=500, min_conns=2, min_material=1), flows.exfil(vol, 900, 500, 2, 1), "window_end", "detector_id")
    assert a == b and a

    # a record is held once, with its timers, and all of it goes
    assert max(sizes) <= 4 * len(rows) and sizes[-1] <= 8


def test_strobes_are_no_beacons(spark):
    rows = [("a", [float(i) for i in range(100)], 100), ("b", sorted(random.Random(5).expovariate(1) ** 3 * 50 for _ in range(100)), 100), ("c", [1.0, 2.0], 2)]
    df = spark.createDataFrame(rows, "src string, times array<double>, n_rows long")
    assert [r.src for r in trailing.strobes(df).collect()] == ["b"]


def test_features_by_hand():
    p = trailing.TrailingFlows(["k"], 60, 30, 10.0)
    s = 1_000_000
    got = p.features([(1 * s, "a", 7.0, 5.0, 1.0), (2 * s, "a", 7.0, 12.0, 2.0), (2 * s, "b", 7.0, 3.0, 4.0), (2 * s, "c", 8.0, 0.0, 0.0)])
    assert got == ([1.0, 2.0, 2.0], [7.0, 7.0, 8.0], 4, 15.0, 3, 1, 6.0)
    with pytest.raises(ValueError):
        trailing.TrailingFlows(["k"], 50, 30, 1.0)
