"""Running streams: checkpointed writes, per-batch thresholds, late-row accounting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..sources.config import Thresholds
from ..sources.sinks import Writer


def start(df: DataFrame, writer: Writer, checkpoint: str, every: str | None = None, mode: str = "append") -> StreamingQuery:
    """Starts a stream into a writer. Offsets are committed after the batch is written; a repeated batch has the same
    number, by which writers replace what they wrote before. Without ``every``, what is there is processed, then it ends."""
    out = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(writer)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def with_thresholds(detect: Callable[[DataFrame, Thresholds], DataFrame], read: Callable[[], Thresholds], writer: Writer) -> Writer:
    """A writer that detects within each batch by the thresholds of that moment: settings change without a restart."""
    return lambda df, batch: writer(detect(df, read()), batch)


class Progress(StreamingQueryListener):
    """Keeps, per query, the rows read, those dropped as late, and the watermark: what proves that a window was evaluated."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.late: dict[str, int] = {}
        self.watermark: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name = p.name or str(p.id)
        self.rows[name] = self.rows.get(name, 0) + p.numInputRows
        self.late[name] = self.late.get(name, 0) + sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        self.watermark[name] = p.eventTime.get("watermark", self.watermark.get(name, ""))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
