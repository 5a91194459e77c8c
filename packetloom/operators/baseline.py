"""Outbound-volume anomalies against an entity's own and its peers' history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import stats
from ..functions.core import let


def outbound_windows(obs: DataFrame, key: list[str], entity: str, ts: str, value: str, seconds: int = 300, identity: str | None = None) -> DataFrame:
    """Sums per entity and epoch-aligned window: start (epoch seconds), bytes_out; an observation counts once."""
    rows = obs.dropDuplicates([*key, identity]) if identity else obs
    start = (F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000)) * seconds).cast("long")
    return rows.groupBy(*key, entity, start.alias("start")).agg(F.sum(value).alias("bytes_out"))


def _robust(values: Column, floor: float) -> Column:
    """Struct (n, median, scale) of an array of numbers; scale = max(1.4826 MAD, floor, median / 10)."""

    def scaled(xs: Column, mid: Column) -> Column:
        mad = stats.sorted_median(F.array_sort(F.transform(xs, lambda x: F.abs(x - mid))))
        return F.struct(F.size(xs).alias("n"), mid.alias("median"), F.greatest(1.4826 * mad, F.lit(float(floor)), mid * 0.1).alias("scale"))

    return let(F.array_sort(values), lambda xs: let(stats.sorted_median(xs), lambda mid: scaled(xs, mid)))


def outbound_anomalies(
    windows: DataFrame, cohort: list[str], entity: str, seconds: int = 300, history: int = 288, min_samples: int = 3, min_peers: int = 2, threshold: float = 6.0, floor: float = 1024.0
) -> DataFrame:
    """Windows far above both the entity's own and its peers' earlier windows: score, mode, baselines.

    History is the ``history`` windows before the scored one, strictly before it: a window is scored
    before it is learned. The peer baseline is required (samples and distinct peers); without an own
    baseline the peers decide alone. windows: cohort, entity, start (epoch seconds), bytes_out.

    The own baseline comes first, by a window over each entity's few earlier rows: a window that is not far above it
    cannot be reported, so only the rest, and entities without an own baseline, ask for their peers. The windows of a cohort
    are gathered once per coarse time block in which something is asked, together with those of the block before; no
    pair of windows is ever a row. A cohort's peers of two blocks fit a row. Windows without a sum count for nothing.
    """
    span = history * seconds
    value = F.col("bytes_out").cast("double")
    block = F.floor(F.col("start") / span)
    known = windows.filter("bytes_out IS NOT NULL")
    mine = Window.partitionBy(*cohort, entity).orderBy("start").rangeBetween(-span, -seconds)
    far = lambda p: F.greatest(F.lit(0.0), (F.col("bytes_out") - F.col(f"_{p}.median")) / F.col(f"_{p}.scale"))
    has_own = F.col("_o.n") >= min_samples
    asked = known.withColumn("_own", F.collect_list(value).over(mine)).withColumn("_o", _robust(F.col("_own"), floor)).drop("_own")
    asked = asked.filter(~has_own | (far("o") > threshold)).withColumn("_block", block)
    seen = known.select(*cohort, F.explode(F.array(block, block + 1)).alias("_block"), F.struct("start", F.col(entity).alias("who"), value.alias("v")).alias("_h"))
    pool = seen.join(asked.select(*cohort, "_block").distinct(), [*cohort, "_block"], "left_semi").groupBy(*cohort, "_block").agg(F.collect_list("_h").alias("_pool"))
    row = asked.join(pool, [*cohort, "_block"])
    peers = F.filter("_pool", lambda h: (h["start"] >= F.col("start") - span) & (h["start"] + seconds <= F.col("start")) & (h["who"] != F.col(entity)))
    row = row.withColumn("_peers", peers).filter(F.size("_peers") >= min_samples)
    row = row.withColumn("n_peers", F.size(F.array_distinct(F.col("_peers.who")))).filter(F.col("n_peers") >= min_peers)
    row = row.withColumn("_p", _robust(F.col("_peers.v"), floor))
    score = F.when(has_own, F.least(far("o"), far("p"))).otherwise(far("p"))
    mode = F.when(has_own, F.lit("entity-and-peer")).otherwise(F.lit("peer-only-cold-start"))
    figures = [F.col(f"_{p[0]}.{c}").alias(f"{p}_{c}") for p in ("peer", "own") for c in ("median", "n", "scale")]
    out = row.select(*windows.columns, "n_peers", *figures, score.alias("score"), mode.alias("mode"), F.when(has_own, 0.8).otherwise(0.5).alias("confidence"))
    return out.filter(F.col("score") > threshold)
