"""Bounded sources of buffers: zeros, test patterns, replayed data, files in chunks, test pictures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowframe import runtime, schema

PATTERNS = ("zero", "ones", "counter", "random", "alternating", "sequence")
#: Seed of the random pattern, shifts of its generator, and the bytes of the alternating one (fixed values).
RANDOM_SEED, SHIFTS, ALTERNATING = 0x853C49E6748FEA9B, (13, 7, 17), (0x55, 0xAA)


def _numbered(df: DataFrame, interval: int) -> DataFrame:
    pts = F.col("sequence") * F.lit(interval)
    return schema.complete(df.withColumns({"stream_id": F.lit(0), "pts": pts, "dts": pts, "flags": F.lit(0), "offset": F.lit(0).cast("long")}))


def null_source(spark: SparkSession, count: int, size: int = 64, interval: int = 0) -> DataFrame:
    """``count`` buffers of ``size`` zero bytes."""
    rows = spark.range(count).select(F.col("id").alias("sequence"), F.unhex(F.repeat(F.lit("00"), size)).alias("payload"))
    return _numbered(rows, interval)


def pattern_bytes(pattern: str, sequence: int, size: int) -> bytes:
    """The bytes of the buffer ``sequence``. Counter goes on from buffer to buffer and wraps at 256; random depends on
    the buffer's number alone, so that buffers can be made anywhere."""
    if pattern == "zero":
        return bytes(size)
    if pattern == "ones":
        return b"\xff" * size
    if pattern == "counter":
        return ((np.arange(size) + sequence * size) % 256).astype(np.uint8).tobytes()
    if pattern == "alternating":
        return (bytes(ALTERNATING) * (size // 2 + 1))[:size]
    if pattern == "sequence":
        return (int(sequence).to_bytes(8, "little") * (size // 8 + 1))[:size]
    if pattern == "random":
        state, out = (RANDOM_SEED ^ (sequence * 0x9E3779B97F4A7C15)) & (2**64 - 1) or 1, bytearray()
        a, b, c = SHIFTS
        while len(out) < size:
            state ^= (state << a) & (2**64 - 1)
            state ^= state >> b
            state ^= (state << c) & (2**64 - 1)
            out += state.to_bytes(8, "little")
        return bytes(out[:size])
    raise ValueError(f"no such pattern: {pattern}")


def pattern_source(spark: SparkSession, pattern: str = "counter", count: int = 10, size: int = 64, interval: int = 0) -> DataFrame:
    """``count`` buffers of a pattern: zero, ones, counter, random, alternating or sequence."""
    if pattern not in PATTERNS:
        raise ValueError(f"no such pattern: {pattern}")
    runtime.ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pattern_bytes(pattern, n, size) for n in batch.column("sequence").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("sequence"), pa.array(made, pa.binary())], names=["sequence", "payload"])

    return _numbered(spark.range(count).select(F.col("id").alias("sequence")).mapInArrow(run, "sequence long, payload binary"), interval)


def data_source(spark: SparkSession, data: bytes, chunk: int, repeat: int = 0) -> DataFrame:
    """``data`` in chunks, ``1 + repeat`` times over."""
    per = -(-len(data) // chunk)
    rows = spark.range(per * (1 + repeat)).select(F.col("id").alias("sequence"), ((F.col("id") % max(per, 1)) * chunk).alias("at"))
    return _numbered(rows.select("sequence", F.substring(F.lit(data), (F.col("at") + 1).cast("int"), F.lit(chunk)).alias("payload")), 0)


def file_source(spark: SparkSession, location: str, chunk: int = 65536) -> DataFrame:
    """Files in chunks of ``chunk`` bytes: a stream for each file, in order of paths, with byte offsets."""
    files = spark.read.format("binaryFile").load(location).select("path", "content", "length").where("length > 0")
    from flowframe.plans.scan import with_index

    streams = with_index(files.select("path"), ["path"], "stream_id")
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(chunk).cast("long"))
    pieces = files.select("path", "content", F.posexplode(starts).alias("k", "at")).select(
        "path", F.col("k").cast("long").alias("sequence"), F.col("at").alias("offset"), F.substring("content", (F.col("at") + 1).cast("int"), F.lit(chunk)).alias("payload")
    )
    joined = pieces.join(streams, "path").withColumn("stream_id", F.col("stream_id").cast("int"))
    return schema.complete(joined.withColumn("flags", F.lit(0)))


def video_test_source(spark: SparkSession, pattern: str, width: int, height: int, frames: int, frame_duration: int = 33_333_333) -> DataFrame:
    """RGB frames of a pattern (bars, checkers, gradient, solid, noise) with times a frame apart."""
    runtime.ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [picture(pattern, width, height, n) for n in batch.column("sequence").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("sequence"), pa.array(made, pa.binary())], names=["sequence", "payload"])

    return _numbered(spark.range(frames).select(F.col("id").alias("sequence")).mapInArrow(run, "sequence long, payload binary"), frame_duration)


#: Colours of the bars, left to right (fixed values): white, yellow, cyan, green, magenta, red, blue, black.
BARS = ((255, 255, 255), (255, 255, 0), (0, 255, 255), (0, 255, 0), (255, 0, 255), (255, 0, 0), (0, 0, 255), (0, 0, 0))


def picture(pattern: str, width: int, height: int, frame: int = 0) -> bytes:
    y, x = np.mgrid[0:height, 0:width]
    if pattern == "bars":
        out = np.array(BARS, np.uint8)[x * 8 // width]
    elif pattern == "checkers":
        out = np.repeat((((x // 8 + y // 8) % 2) * 255).astype(np.uint8)[..., None], 3, 2)
    elif pattern == "gradient":
        out = np.repeat((x * 255 // max(width - 1, 1)).astype(np.uint8)[..., None], 3, 2)
    elif pattern == "solid":
        out = np.full((height, width, 3), 128, np.uint8)
    elif pattern == "noise":
        out = np.random.default_rng(frame).integers(0, 256, (height, width, 3), np.uint8)
    else:
        raise ValueError(f"no such pattern: {pattern}")
    return out.astype(np.uint8).tobytes()
