"""Streaming forms of the windowed detections.

Event time everywhere; late rows beyond the watermark are dropped and counted by the engine
(numRowsDroppedByWatermark). Distinct counts keep the sets of members as state, bounded by the
window and the watermark; the expressions are those of the batch operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules, stats, time

LATENESS = "60 seconds"


def watermarked(events: DataFrame, ts: str = "event_time", lateness: str | None = LATENESS) -> DataFrame:
    """``events`` with a watermark; a lateness of None says that they have one already."""
    if lateness is None:
        return events
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def once(events: DataFrame, identity: list[str], ts: str = "event_time", lateness: str = LATENESS) -> DataFrame:
    """Each identity once within the watermark's reach: replay-safe input."""
    return watermarked(events, ts, lateness).dropDuplicatesWithinWatermark(identity)


def distinct_members(events: DataFrame, key: list[str], member: Column, width: str, least: int, ts: str = "event_time", lateness: str | None = LATENESS) -> DataFrame:
    """Closed tumbling windows with at least ``least`` distinct members: key, window_start, n. (Scans and fan-outs.)"""
    rows = watermarked(events, ts, lateness).groupBy(*key, F.window(ts, width).alias("w")).agg(F.size(F.collect_set(member)).alias("n"))
    return rows.filter(F.col("n") >= least).select(*key, F.col("w.start").alias("window_start"), "n")


def bursts(events: DataFrame, key: list[str], where: Column, width: str, least: int, ts: str = "event_time", lateness: str | None = LATENESS) -> DataFrame:
    """Closed tumbling windows with at least ``least`` rows that meet a condition."""
    rows = watermarked(events.filter(where), ts, lateness).groupBy(*key, F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.filter(F.col("n") >= least).select(*key, F.col("w.start").alias("window_start"), "n")


def volumes(flows: DataFrame, key: list[str], identity: list[str], value: str, width: str = "10 minutes", ts: str = "event_time", lateness: str | None = LATENESS) -> DataFrame:
    """Per pair and closed window: total and flows, the last record of a flow standing for it.

    The state of a window is one entry a flow: the largest (time, value) per identity, kept in a map built
    from the collected records when the window closes.
    """
    rows = watermarked(flows, ts, lateness).groupBy(*key, *identity, F.window(ts, width).alias("w")).agg(F.max(F.struct(F.col(ts), F.col(value))).alias("last"))
    rows = rows.select(*key, F.col("w"), F.col(f"last.{value}").alias("v"), F.window_time("w").alias("_at"))
    return rows.groupBy(*key, F.window("_at", width).alias("w2")).agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n_flows")).select(*key, F.col("w2.start").alias("window_start"), "total", "n_flows")


def sessions(flows: DataFrame, key: list[str], gap: str, ts: str = "event_time", lateness: str | None = LATENESS) -> DataFrame:
    """Closed sessions of rows at most a gap apart."""
    rows = watermarked(flows, ts, lateness).groupBy(*key, F.session_window(ts, gap).alias("s"))
    return rows.agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count(F.lit(1)).alias("n")).drop("s")


def beacons(flows: DataFrame, key: list[str], width: str = "10 minutes", slide: str = "30 seconds", size: str | None = None, min_conns: int = 6, threshold: float = 0.8, ts: str = "event_time", lateness: str | None = LATENESS) -> DataFrame:
    """Beacons over trailing windows, evaluated at every slide: key, window_end, n_conns, score."""
    row = watermarked(flows, ts, lateness).withColumn("_t", time.epoch(F.col(ts)))
    pick = [F.collect_set(F.struct("_t", *([F.col(size).cast("double").alias("_s")] if size else []))).alias("m")]
    one = row.groupBy(*key, F.window(ts, width, slide).alias("w")).agg(*pick)
    times, sizes = F.transform("m", lambda x: x["_t"]), F.transform("m", lambda x: x["_s"]) if size else None
    out = one.select(*key, F.col("w.end").alias("window_end"), F.size("m").alias("n_conns"), stats.beacon_score(times, sizes, min_conns).alias("score"))
    return out.filter(F.col("score") >= threshold)


def stateless(events: DataFrame) -> DataFrame:
    """HTTP rule hits, row by row: the batch expressions as they are."""
    return events.withColumn("r", F.explode(rules.http_rules(F.col("method"), F.col("url")))).select("event_time", "tenant", "src_ip", "dest_ip", "url", "r.detector_id", "r.category", "r.severity")
