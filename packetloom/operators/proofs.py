"""What proves that input was evaluated: acknowledgements against the input that they must cover.

Consumed offsets say that records were read, not that the windows they fall into were closed. An
acknowledgement (service, part, batch, evaluated_at, horizon, records; times in epoch seconds)
says that an evaluation ran at ``evaluated_at``; it proves everything up to ``horizon`` seconds
before that. ``part`` is a partition of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

KEY = ["service", "part"]


def coverage(acks: DataFrame, inputs: DataFrame, expected: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Per expected service and part: last_input, evaluated_at, records, behind (seconds of input without proof), verdict.

    evaluated: the last input (``at`` in ``inputs``) is proved; behind: evaluations came, but too early; missing: there is
    input and no evaluation; idle: neither. A batch that was repeated counts once, by its latest acknowledgement.
    """
    last = inputs.groupBy(*key).agg(F.max("at").alias("last_input"))
    one = acks.groupBy(*key, "batch").agg(
        F.max("evaluated_at").alias("evaluated_at"), F.max(F.col("evaluated_at") - F.col("horizon")).alias("_proved"),
        F.max_by("records", F.struct("evaluated_at", "records")).alias("records"),
    )
    done = one.groupBy(*key).agg(F.max("evaluated_at").alias("evaluated_at"), F.max("_proved").alias("_proved"), F.sum("records").alias("records"))
    out = expected.select(*key).distinct().join(last, key, "left").join(done, key, "left")
    seen, proved = F.col("last_input"), F.col("_proved")
    verdict = (
        F.when(proved.isNull() & seen.isNull(), "idle").when(proved.isNull(), "missing")
        .when(seen.isNull() | (proved >= seen), "evaluated").otherwise("behind")
    )
    behind = F.when(proved.isNotNull() & seen.isNotNull(), F.greatest(seen - proved, F.lit(0)))
    return out.select(*key, "last_input", "evaluated_at", "records", behind.alias("behind"), verdict.alias("verdict"))


def window_proofs(windows: DataFrame, acks: DataFrame, key: list[str] = KEY) -> DataFrame:
    """``windows`` (key, until: the window's end) with evaluated_at: the first evaluation that proves the whole window, null if none does.

    One union and one running minimum from the latest time on, so no window meets every acknowledgement.
    """
    ends = windows.select(*key, F.col("until").alias("_at"), F.lit(None).cast("double").alias("_done"), F.struct(*windows.columns).alias("_w"))
    marks = acks.filter((F.col("evaluated_at") - F.col("horizon")).isNotNull()).select(
        *key, (F.col("evaluated_at") - F.col("horizon")).alias("_at"), F.col("evaluated_at").cast("double").alias("_done")
    )
    later = Window.partitionBy(*key).orderBy(F.col("_at").desc()).rangeBetween(Window.unboundedPreceding, 0)
    both = ends.unionByName(marks, allowMissingColumns=True).withColumn("_done", F.min("_done").over(later))
    return both.filter("_w IS NOT NULL").select("_w.*", F.col("_done").alias("evaluated_at"))


def batch_gaps(acks: DataFrame, key: list[str] = ["service"]) -> DataFrame:  # noqa: B006
    """Runs of batch numbers (from 0) that nothing acknowledged before the latest that something did: first_missing, last_missing."""
    before = F.lag("batch", 1, -1).over(Window.partitionBy(*key).orderBy("batch"))
    one = acks.filter("batch IS NOT NULL").select(*key, "batch").distinct().withColumn("_before", before)
    return one.filter(F.col("batch") > F.col("_before") + 1).select(*key, (F.col("_before") + 1).alias("first_missing"), (F.col("batch") - 1).alias("last_missing"))


def worker_totals(counters: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """Counters that workers keep for themselves: the latest of each (key, worker), summed over workers; a restarted worker is another one."""
    last = counters.groupBy(*key, "worker").agg(F.max_by(value, F.struct(order, value)).alias("_v"))
    return last.groupBy(*key).agg(F.sum("_v").alias(value), F.count(F.lit(1)).alias("workers"))
