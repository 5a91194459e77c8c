"""Sensor health: capture loss, blindness, quality labels, checksum rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules


def capture_loss(packets: Column, drops: Column) -> Column:
    """Share of packets dropped; null when either counter is absent or both are 0."""
    return F.try_divide(drops.cast("double"), (drops + packets).cast("double"))


def app_layer_ratio(flows: Column, packets: Column, min_packets: int = 5000) -> Column:
    """Application flows (a map of counters) per packet; null under ``min_packets`` or when absent."""
    total = F.aggregate(F.map_values(flows), F.lit(0).cast("long"), lambda a, v: a + F.coalesce(v, F.lit(0)))
    return F.when(packets >= min_packets, F.try_divide(total.cast("double"), packets.cast("double")))


def quality(loss: Column, ratio: Column, max_loss: float = 0.02, min_ratio: float = 0.001) -> Column:
    """blind, degraded, good or unknown; an absent measure is not a measured zero."""
    blind, lossy = F.coalesce(ratio <= min_ratio, F.lit(False)), F.coalesce(loss >= max_loss, F.lit(False))
    return F.when(blind, F.lit("blind")).when(lossy, F.lit("degraded")).when(loss.isNull() & ratio.isNull(), F.lit("unknown")).otherwise(F.lit("good"))


def discounted(confidence: Column, label: Column, degraded: float = 0.7, blind: float = 0.4, floor: float = 0.05) -> Column:
    """Confidence under a sensor's quality: lowered, never under the floor, never raised."""
    base = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    factor = F.when(label == "blind", blind).when(label == "degraded", degraded)
    return F.when(factor.isNull(), confidence).otherwise(F.least(base, F.greatest(F.lit(floor), base * factor)))


def sensor_quality(stats: DataFrame) -> DataFrame:
    """stats (tenant, sensor, ts, kernel_packets, kernel_drops, decoder_packets, flows) with loss, ratio and quality."""
    loss = capture_loss(F.col("kernel_packets"), F.col("kernel_drops"))
    ratio = app_layer_ratio(F.col("flows"), F.col("decoder_packets"))
    return stats.withColumn("loss", loss).withColumn("ratio", ratio).withColumn("quality", quality(F.col("loss"), F.col("ratio")))


def checksum_health(anomalies: DataFrame, key: list[str], kind: str, event: str, min_share: float = 0.5, least: int = 200, mixed: float = 0.05) -> DataFrame:
    """Keys (sensor and window) whose anomalies are mostly invalid checksums: counts, share and verdict."""
    k, e = F.col(kind), F.col(event)
    checksum = rules.is_checksum_anomaly(k, e)
    one = anomalies.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(checksum).alias("n_checksum"), F.count_if(~checksum & (F.lower(k) == "decode")).alias("n_other_decode")
    )
    share = F.col("n_checksum") / F.col("n")
    out = one.filter((F.col("n") >= least) & (share >= min_share)).withColumn("share", F.round(share, 4))
    other = F.col("n_other_decode") / (F.col("n_checksum") + F.col("n_other_decode"))
    return out.withColumn("verdict", F.when(other > mixed, F.lit("link_corruption_suspected")).otherwise(F.lit("checksum_validation_suspected")))
