"""The canonical row: a buffer of bytes with its timing metadata, as Spark columns.

Times are nanoseconds in ``long`` columns, null for "none"; ``ts`` is the event time that watermarks need, in
microseconds. Order is never implicit: operators name the columns that order a stream, ``sequence`` by default,
and the columns that tell streams apart, ``stream_id`` by default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _fields(*named: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in named])


_INT, _LONG, _TEXT = T.IntegerType(), T.LongType(), T.StringType()
RTP = _fields(("seq", _INT), ("ts", _LONG), ("ssrc", _LONG), ("pt", _INT), ("marker", T.BooleanType()))
BUFFER = _fields(
    ("stream_id", _INT),
    ("sequence", _LONG),
    ("pts", _LONG),
    ("dts", _LONG),
    ("duration", _LONG),
    ("flags", _INT),
    ("offset", _LONG),
    ("rtp", RTP),
    ("format", _TEXT),
    ("payload", T.BinaryType()),
    ("meta", T.MapType(_TEXT, _TEXT)),
    ("ts", T.TimestampType()),
)

#: Bits of ``flags`` (fixed values).
SYNC_POINT, EOS, CORRUPTED, DISCONT, DELTA, HEADER, DECODE_ONLY, TIMEOUT = 1, 2, 4, 8, 16, 32, 64, 128
FLAGS = {"SYNC_POINT": 1, "EOS": 2, "CORRUPTED": 4, "DISCONT": 8, "DELTA": 16, "HEADER": 32, "DECODE_ONLY": 64, "TIMEOUT": 128}

STREAM, ORDER = ("stream_id",), ("sequence",)


def complete(df: DataFrame) -> DataFrame:
    """``df`` with every canonical column, in canonical order, nulls where it has none; others follow."""
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in BUFFER.fields if f.name not in df.columns]
    rest = [c for c in df.columns if c not in BUFFER.fieldNames()]
    return df.select("*", *missing).select(*BUFFER.fieldNames(), *rest)


def floor_div(a: Column, b: int | Column) -> Column:
    """The floor of ``a / b`` for whole numbers, exact for every long; ``b`` is positive."""
    b = F.lit(b).cast("long") if isinstance(b, int) else b
    return F.call_function("div", a - F.pmod(a, b), b)


def nanos(ts: Column) -> Column:
    """A timestamp column (with or without zone; the session's zone is taken as UTC) in nanoseconds."""
    return F.unix_micros(ts.cast("timestamp")) * 1000


def timestamp(ns: Column) -> Column:
    """Nanoseconds to a timestamp, cut to microseconds."""
    return F.timestamp_micros(floor_div(ns, 1000))


def from_events(events: DataFrame) -> DataFrame:
    """Buffers from (event_id, ts, user_id, event_type, value, props): a stream for each user."""
    pts = nanos(F.col("ts"))
    return complete(
        events.select(
            F.col("user_id").cast("int").alias("stream_id"),
            F.col("event_id").alias("sequence"),
            pts.alias("pts"),
            pts.alias("dts"),
            F.when(F.col("event_type") == "purchase", SYNC_POINT).otherwise(0).alias("flags"),
            F.col("props").cast("binary").alias("payload"),
            F.create_map(F.lit("event_type"), F.col("event_type")).alias("meta"),
            F.col("ts").cast("timestamp").alias("ts"),
            "event_type",
            "value",
        )
    )


def from_documents(documents: DataFrame, interval_ns: int = 40_000_000) -> DataFrame:
    """Buffers from (doc_id, text, lang, source): one stream, a document each ``interval_ns``."""
    pts = F.col("doc_id") * F.lit(interval_ns)
    return complete(
        documents.select(
            F.lit(0).alias("stream_id"),
            F.col("doc_id").alias("sequence"),
            pts.alias("pts"),
            pts.alias("dts"),
            F.lit(interval_ns).cast("long").alias("duration"),
            F.lit(0).alias("flags"),
            F.col("text").cast("binary").alias("payload"),
            F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("meta"),
            timestamp(pts).alias("ts"),
        )
    )
