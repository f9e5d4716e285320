"""Operators on metadata: sequence numbers, timestamps, constants, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowframe.plans.scan import annotate, stream_index
from flowframe.schema import ORDER, STREAM, floor_div


def sequence_number(df: DataFrame, start: int = 0, increment: int = 1, partition_by=STREAM, order_by=ORDER, spread: bool = False) -> DataFrame:
    """``sequence`` becomes ``start + i * increment`` along each stream. ``spread``: see ``stream_index``."""
    placed = stream_index(df, partition_by, order_by, "_i", spread)
    return placed.withColumn("sequence", F.lit(start) + F.col("_i") * increment).drop("_i")


def timestamper(df: DataFrame, mode: str = "system", base: Column | None = None) -> DataFrame:
    """Set times: ``system`` (now) or ``monotonic`` (now since ``base``, or since the query began) for pts and dts,
    ``pts_only``, ``dts_only``, or ``preserve``."""
    now = F.unix_micros(F.current_timestamp()) * 1000
    if mode == "monotonic":
        now = now - (base if base is not None else now)
    columns = {"system": ("pts", "dts"), "monotonic": ("pts", "dts"), "pts_only": ("pts",), "dts_only": ("dts",), "preserve": ()}[mode]
    return df.withColumns({c: now for c in columns}) if columns else df


def inject(df: DataFrame, **constants) -> DataFrame:
    """Set metadata such as stream_id, duration or offset to constants."""
    return df.withColumns({k: F.lit(v).cast(df.schema[k].dataType) if k in df.columns else F.lit(v) for k, v in constants.items()})


def extract(df: DataFrame) -> DataFrame:
    """The side channel: each buffer's metadata and size without its payload."""
    return df.select(*(c for c in df.columns if c != "payload"), F.octet_length("payload").alias("size"))


def _timestamps():
    count, last, mean = 0, None, None

    def step(pts: int | None) -> tuple:
        nonlocal count, last, mean
        count += 1
        if pts is None:
            return ("MISSING_PTS", None)
        status, gap = "OK", None
        if last is not None:
            gap = pts - last
            forward = float(max(gap, 0))
            if gap < 0:
                status = "BACKWARDS_PTS"
            if mean is not None and forward > 2 * mean:
                status = "DISCONTINUITY"
            mean = forward if mean is None else mean + (forward - mean) / count
        last = pts
        return (status, gap)

    return step


def timestamp_debug(df: DataFrame, partition_by=STREAM, order_by=ORDER) -> DataFrame:
    """``status`` of each timestamp (OK, MISSING_PTS, BACKWARDS_PTS, DISCONTINUITY) and its ``gap`` to the last.

    A gap over twice the running mean of gaps is a discontinuity; the first gap begins the mean, and each gap is
    judged before it is taken in.
    """
    return annotate(df, _timestamps, [F.col("pts")], "status string, gap bigint", partition_by, order_by)


def timestamp_summary(df: DataFrame, partition_by=STREAM, order_by=ORDER) -> DataFrame:
    """By window functions: per stream the rows without pts, those that go back, the least, greatest and last pts."""
    before = F.last("pts", ignorenulls=True).over(W.partitionBy(*partition_by).orderBy(*order_by).rowsBetween(W.unboundedPreceding, -1))
    marked = df.select(*partition_by, *order_by, "pts", before.alias("_before"))
    return marked.groupBy(*partition_by).agg(
        F.count("*").alias("n_buffers"),
        F.count_if(F.col("pts").isNull()).alias("n_missing"),
        F.count_if(F.col("pts") < F.col("_before")).alias("n_backwards"),
        F.min("pts").alias("min_pts"),
        F.max("pts").alias("max_pts"),
        F.max_by("pts", F.when(F.col("pts").isNotNull(), F.struct(*order_by))).alias("last_pts"),
    )


def clock_format(ns: Column) -> Column:
    """``HH:MM:SS.mmm``, or ``NONE``."""
    ms = floor_div(ns, 1_000_000)
    text = F.format_string("%02d:%02d:%02d.%03d", floor_div(ms, 3_600_000), floor_div(ms, 60_000) % 60, floor_div(ms, 1000) % 60, ms % 1000)
    return F.when(ns.isNull(), "NONE").otherwise(text)


def console_text(df: DataFrame, style: str = "metadata", most_bytes: int = 64) -> DataFrame:
    """One ``line`` for each buffer: ``metadata``, ``hex``, ``text`` or ``full``."""
    head = F.substring("payload", 1, most_bytes)
    meta = F.format_string("seq=%d pts=%s size=%d", F.col("sequence"), clock_format(F.col("pts")), F.octet_length("payload"))
    hexed, text = F.lower(F.hex(head)), F.decode(head, "UTF-8")
    line = {"metadata": meta, "hex": hexed, "text": text, "full": F.concat(meta, F.lit(" "), hexed)}[style]
    return df.select("stream_id", "sequence", line.alias("line"))
