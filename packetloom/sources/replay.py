"""Replay of recorded events at their own pace: when each is due, and a stream that gives them then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Seconds of record that are ordered by one task.
BLOCK = 3600


def due(events: DataFrame, ts: str = "event_time", speed: float = 1.0, max_gap: float | None = None, block: int = BLOCK) -> DataFrame:
    """``events`` with due: microseconds from the first event's time, at ``speed``, to when each is sent.

    With ``max_gap`` (seconds) longer gaps between neighbours count as that long: faster, but no longer the recorded
    timing. Events without a time have no due. Without a gap's limit no order is needed. With one, distinct times are
    ordered within blocks of time, and only blocks (one row each) over all.
    """
    if speed <= 0 or (max_gap is not None and max_gap < 0):
        raise ValueError("speed must be above 0, max_gap no less")
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    scaled = lambda micros: F.floor(micros / F.lit(float(speed))).cast("long")
    if max_gap is None:
        first = events.agg(F.min(at).alias("_first"))
        return events.join(F.broadcast(first)).withColumn("due", scaled(at - F.col("_first"))).drop("_first")
    most = F.lit(int(max_gap * 1_000_000))
    times = events.select(at.alias("_at")).filter("_at IS NOT NULL").distinct().withColumn("_block", F.floor(F.col("_at") / (block * 1_000_000)))
    inside = Window.partitionBy("_block").orderBy("_at")
    times = times.withColumn("_gap", F.least(most, F.coalesce(F.col("_at") - F.lag("_at").over(inside), F.lit(0))))
    times = times.withColumn("_run", F.sum("_gap").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = times.groupBy("_block").agg(F.min("_at").alias("_from"), F.max("_at").alias("_to"), F.max("_run").alias("_length"))
    over = Window.orderBy("_block")
    blocks = blocks.withColumn("_step", F.least(most, F.coalesce(F.col("_from") - F.lag("_to").over(over), F.lit(0))))
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_block", (F.coalesce(F.sum("_length").over(before), F.lit(0)) + F.sum("_step").over(over.rowsBetween(Window.unboundedPreceding, 0))).alias("_base"))
    when = times.join(blocks, "_block").select("_at", scaled(F.col("_base") + F.col("_run")).alias("due"))
    return events.withColumn("_at", at).join(when, "_at", "left").drop("_at")


def stage(scheduled: DataFrame, path: str, tick: float = 1.0) -> None:
    """Writes events with ``due`` in a folder a tick (seconds), so that a batch of the stream reads its ticks only. Events that are never due go."""
    number = F.floor(F.col("due") / int(tick * 1_000_000)).cast("long")
    scheduled.filter("due IS NOT NULL").withColumn("tick", number).repartitionByRange("tick", "due").write.mode("overwrite").partitionBy("tick").parquet(path)


def paced(clock: DataFrame, path: str, tick: str = "value") -> DataFrame:
    """Staged events as the clock's ticks come. ``clock`` is a stream with one row a tick, numbered from 0.

    Spark's sources ``rate`` (real time) and ``rate-micro-batch`` (a manual clock: equal batches in every run) are such.
    """
    spark: SparkSession = clock.sparkSession
    ticks = clock.select(F.col(tick).cast("long").alias("tick"))
    return spark.read.parquet(path).join(F.broadcast(ticks), "tick")


def wall_clock(spark: SparkSession, tick: float = 1.0) -> DataFrame:
    """Ticks in real time; a tick is a second or an even part of it."""
    per_second = round(1 / tick)
    if per_second < 1 or abs(per_second * tick - 1) > 1e-9:
        raise ValueError("a tick must be a second or an even part of it")
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).option("numPartitions", 1).load()


def manual_clock(spark: SparkSession, ticks_per_batch: int = 1) -> DataFrame:
    """Ticks by batch number, whatever the time."""
    return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", ticks_per_batch).option("numPartitions", 1).load()
