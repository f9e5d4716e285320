"""Counts of what passes, for bounded DataFrames and for streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` as it is; after an action the observation has its buffers, bytes and the ends of its times."""
    seen = Observation(name)
    metrics = [F.count("*").alias("n_buffers"), F.sum(F.octet_length("payload")).alias("n_bytes"), F.min("pts").alias("first_pts"), F.max("pts").alias("last_pts")]
    return df.observe(seen, *metrics), seen


class ProgressLog(StreamingQueryListener):
    """Keeps what each micro-batch reports; add with ``spark.streams.addListener``."""

    def __init__(self) -> None:
        self.started: list[str] = []
        self.batches: list[dict] = []
        self.ended: list[str] = []

    def onQueryStarted(self, event) -> None:
        self.started.append(str(event.id))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append({"batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.append(str(event.id))
