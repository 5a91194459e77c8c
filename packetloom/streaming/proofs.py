"""Streams that prove what they evaluated: an acknowledgement for each batch, written after it.

The acknowledgements of a batch are a folder of their own, so a repeated batch replaces its own, and
one that was lost between its output and its acknowledgement is acknowledged when it is repeated.
``operators.proofs`` reads them.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.sinks import Writer

ACK = "service string, part long, worker string, evaluated_at double, horizon long, records long, last_event timestamp, batch long"
#: The part that stands for a batch as a whole; it is there for empty batches too.
WHOLE = -1


def proving(writer: Writer, service: str, path: str, horizon: int, part: str = "partition", ts: str = "event_time", clock: Callable[[], float] = time.time) -> Writer:
    """``writer``, and after it an acknowledgement for each part of the input that the batch has rows of, and one for the whole batch."""
    worker = uuid.uuid4().hex

    def write(df: DataFrame, batch: int) -> None:
        df = df.persist()
        try:
            writer(df, batch)
            now, figures = clock(), [F.count(F.lit(1)).alias("records"), F.max(F.col(ts).cast("timestamp")).alias("last_event")]
            parts = df.groupBy(F.col(part).cast("long").alias("part")).agg(*figures).filter("part IS NOT NULL")
            rows = parts.unionByName(df.agg(*figures).withColumn("part", F.lit(WHOLE).cast("long")))
            rows = rows.withColumns({"service": F.lit(service), "worker": F.lit(worker), "evaluated_at": F.lit(float(now)), "horizon": F.lit(horizon).cast("long"), "batch": F.lit(batch).cast("long")})
            rows.select(*[c.split()[0] for c in ACK.split(", ")]).coalesce(1).write.mode("overwrite").parquet(f"{path}/{service}/b{batch}")
        finally:
            df.unpersist()

    return write


def acknowledged(spark: SparkSession, path: str, service: str = "*") -> DataFrame:
    """The acknowledgements that streams wrote under ``path``."""
    return spark.read.schema(ACK).option("recursiveFileLookup", "true").parquet(f"{path}/{service}")
