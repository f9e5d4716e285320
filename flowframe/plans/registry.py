"""Elements by name: what a pipeline description can refer to."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowframe import schema
from flowframe.operators import filters, meta, payload, timing, typed
from flowframe.sources import generators


@dataclass(frozen=True)
class Element:
    """``kind``: source, transform or sink. A source makes a DataFrame from a session and properties; a transform
    takes one to another; a sink runs it and returns what it gives."""

    kind: str
    make: Callable
    takes: str = "buffer"
    gives: str = "buffer"


REGISTRY: dict[str, Element] = {}


def register(name: str, kind: str, make: Callable, takes: str = "buffer", gives: str = "buffer") -> None:
    """Add an element, or replace one: this is how a plug-in extends the pipeline language."""
    REGISTRY[name] = Element(kind, make, takes, gives)


def _parquet(spark: SparkSession, path: str = "", table: str = "events") -> DataFrame:
    df = spark.read.parquet(f"{path}/{table}.parquet")
    return {"events": schema.from_events, "documents": schema.from_documents}.get(table, schema.complete)(df)


def _sum(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_buffers"), F.sum(F.octet_length("payload")).alias("n_bytes"))


register("parquetsrc", "source", _parquet)
register("nullsource", "source", lambda spark, count=10, size=64: generators.null_source(spark, count, size))
register("testsrc", "source", lambda spark, pattern="counter", count=10, size=64: generators.pattern_source(spark, pattern, count, size))
register("datasrc", "source", lambda spark, data="", chunk=16, repeat=0: generators.data_source(spark, str(data).encode(), chunk, repeat))
register("filesrc", "source", lambda spark, location, chunk=65536: generators.file_source(spark, location, chunk))
for _name in ("passthrough", "identity", "queue", "tee"):
    register(_name, "transform", lambda df, **_: df)
register("filter", "transform", lambda df, expr: filters.predicate(df, F.expr(expr)))
register("sample", "transform", lambda df, every=1: filters.every_nth(df, every))
register("take", "transform", lambda df, count: typed.take(df, count, "sequence"))
register("skip", "transform", lambda df, count: typed.skip(df, count, "sequence"))
register("regex", "transform", lambda df, pattern, inverted=False: filters.by_regex(df, pattern, inverted))
register("range", "transform", lambda df, low=None, high=None: filters.by_size(df, low, high))
register("dedup", "transform", lambda df: filters.drop_duplicates(df))
register("trim", "transform", lambda df, size: payload.trim(df, size))
register("slice", "transform", lambda df, offset, length=None: payload.slice_(df, offset, length))
register("pad", "transform", lambda df, size, fill=0: payload.pad(df, size, fill))
register("split", "transform", lambda df, delimiter="\n": payload.split(df, delimiter))
register("unbatch", "transform", lambda df, size: payload.unbatch(df, size))
register("batch", "transform", lambda df, count=None, size=None: schema.complete(payload.batch(df, count, size).withColumnRenamed("batch", "sequence")))
register("chunk", "transform", lambda df, size: schema.complete(payload.chunk(df, size)))
register("sequence", "transform", lambda df, start=0, increment=1: meta.sequence_number(df, start, increment))
register("inject", "transform", lambda df, **constants: meta.inject(df, **constants))
register("throttle", "transform", lambda df, interval: timing.throttle(df, interval))
register("debounce", "transform", lambda df, quiet: timing.debounce(df, quiet))
register("valve", "transform", lambda df, open=True: filters.valve(df, open))
register("nullsink", "sink", lambda df: typed.discard(df), gives="nothing")
register("collect", "sink", lambda df: df, gives="rows")
register("count", "sink", _sum, gives="rows")
register("consolesink", "sink", lambda df, format="metadata": meta.console_text(df, format), gives="rows")
register("filesink", "sink", lambda df, location: df.write.mode("overwrite").parquet(location), gives="nothing")


def element(name: str, kind: str = "transform", takes: str = "buffer", gives: str = "buffer"):
    """Decorator: register a function of DataFrames (or of a session, for a source) as an element."""

    def add(f: Callable) -> Callable:
        register(name, kind, f, takes, gives)
        return f

    return add
