"""The operators on unbounded streams, as Structured Streaming queries.

Stateless operators of :mod:`flowframe.operators` (map, filter, trim, slice, pad, unbatch, demultiplexing) run on a
streaming DataFrame as they are. Those here need watermarks or state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowframe import runtime


def drop_duplicates(df: DataFrame, content: str = "payload", delay: str = "1 hour") -> DataFrame:
    """The first row of each content within the watermark's delay."""
    return df.withWatermark("ts", delay).dropDuplicatesWithinWatermark([content])


def interval_join(left: DataFrame, right: DataFrame, by: str, tolerance: str, delay: str = "1 hour") -> DataFrame:
    """Pairs of a key whose times are within ``tolerance``; columns of either side in ``left`` and ``right``."""
    a = left.withWatermark("ts", delay).select(F.col(by).alias("_lk"), F.col("ts").alias("_lt"), F.struct(*left.columns).alias("left"))
    b = right.withWatermark("ts", delay).select(F.col(by).alias("_rk"), F.col("ts").alias("_rt"), F.struct(*right.columns).alias("right"))
    near = F.expr(f"_lk = _rk and _rt between _lt - interval {tolerance} and _lt + interval {tolerance}")
    return a.join(b, near).select("left", "right")


def slots(df: DataFrame, width: str, by: str = "stream_id", delay: str = "1 hour") -> DataFrame:
    """Rows and bytes of each stream in slots of event time."""
    counted = df.withWatermark("ts", delay).groupBy(by, F.window("ts", width)).agg(F.count("*").alias("n_buffers"), F.sum(F.octet_length("payload")).alias("n_bytes"))
    return counted.select(by, F.col("window.start").alias("slot"), "n_buffers", "n_bytes")


def sessions(df: DataFrame, gap: str, by: str = "stream_id", delay: str = "1 hour") -> DataFrame:
    counted = df.withWatermark("ts", delay).groupBy(by, F.session_window("ts", gap)).agg(F.count("*").alias("n_buffers"))
    return counted.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n_buffers")


def throttle(df: DataFrame, interval: int, by: str = "stream_id") -> DataFrame:
    """Greedy throttling of each stream by ``pts``; the state is the last time that passed.

    Rows of a micro-batch are taken in order of time; a row that comes in a later batch with an earlier time than
    the last one that passed is dropped.
    """
    runtime.ship(df.sparkSession)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["pts", "sequence"])
        kept = []
        for at, sequence in zip(rows["pts"], rows["sequence"]):
            if passed is None or at - passed >= interval:
                passed = at
                kept.append((key[0], sequence, at))
        if passed is not None:
            state.update((int(passed),))
        yield pd.DataFrame(kept, columns=[by, "sequence", "pts"])

    chosen = df.select(by, "sequence", "pts")
    return chosen.groupBy(by).applyInPandasWithState(run, f"{by} int, sequence long, pts long", "passed long", "append", GroupStateTimeout.NoTimeout)


def batch_by_count(df: DataFrame, count: int, by: str = "stream_id") -> DataFrame:
    """Batches of ``count`` payloads of each stream; what is over waits in the state."""
    runtime.ship(df.sparkSession)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, held = (state.get[0], list(state.get[1])) if state.exists else (0, [])
        rows = pd.concat(list(frames)).sort_values("sequence")
        out = []
        for payload in rows["payload"]:
            held.append(bytes(payload))
            if len(held) == count:
                out.append((key[0], number, b"".join(held)))
                number, held = number + 1, []
        state.update((number, held))
        yield pd.DataFrame(out, columns=[by, "batch", "payload"])

    chosen = df.select(by, "sequence", "payload")
    return chosen.groupBy(by).applyInPandasWithState(run, f"{by} int, batch long, payload binary", "number long, held array<binary>", "append", GroupStateTimeout.NoTimeout)


def fan_out(df: DataFrame, *sinks):
    """A query that gives every micro-batch to each of ``sinks``, functions of (DataFrame, batch number)."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    return df.writeStream.foreachBatch(each)


def run_once(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a streaming DataFrame over all that is there now and return what it gave, from the shared folder.

    In ``append`` mode that is every micro-batch's rows, in ``complete`` mode the last one's.
    """
    spark = df.sparkSession
    out, checkpoint = runtime.new_path(spark, "stream-out"), runtime.new_path(spark, "stream-checkpoint")
    last = []

    def each(batch: DataFrame, number: int) -> None:
        last.append(number)
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], df.schema)
    path = f"{out}/batch={last[-1]}" if mode == "complete" else f"{out}/batch=*"
    return spark.read.schema(df.schema).parquet(path)
