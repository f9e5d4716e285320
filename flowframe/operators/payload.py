"""Operators on payload bytes: cutting, padding, splitting, joining, batching, chunking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowframe import schema
from flowframe.plans.scan import annotate, stream_index
from flowframe.schema import ORDER, STREAM


def size(column: str = "payload") -> Column:
    return F.octet_length(column)


def part(column: str, start: Column, length: Column) -> Column:
    """``length`` bytes of a binary column from byte ``start``, counted from 0."""
    return F.substring(F.col(column), (start + 1).cast("int"), length.cast("int"))


def map_bytes(df: DataFrame, f) -> DataFrame:
    """``f`` takes the payload column to a new one; all else stays."""
    return df.withColumn("payload", f(F.col("payload")))


def filter_map_bytes(df: DataFrame, f) -> DataFrame:
    """As :func:`map_bytes`; null is "none" and the row goes."""
    return map_bytes(df, f).where(F.col("payload").isNotNull())


def flat_map_bytes(df: DataFrame, f, partition_by=STREAM, order_by=ORDER) -> DataFrame:
    """``f`` takes the payload to an array of payloads: a row for each, numbered anew from 0 in each stream."""
    out = df.select("*", F.posexplode(f(F.col("payload"))).alias("_k", "_part"))
    number = F.row_number().over(W.partitionBy(*partition_by).orderBy(*order_by, "_k")) - 1
    return out.withColumns({"payload": F.col("_part"), "sequence": number.cast("long")}).drop("_k", "_part")


def trim(df: DataFrame, most: int) -> DataFrame:
    """Payloads cut to ``most`` bytes."""
    return df.withColumn("payload", part("payload", F.lit(0), F.lit(most)))


def slice_(df: DataFrame, start: int, length: int | None = None, skip_short: bool = False) -> DataFrame:
    """Bytes from ``start`` on, ``length`` of them.

    A payload that ends at or before ``start`` becomes empty with its offset as it was; one that has fewer bytes
    gives what it has; with ``skip_short`` either goes. Otherwise ``offset`` moves by ``start``.
    """
    n = size()
    if skip_short:
        df = df.where((n > start) & (n >= start + length if length is not None else F.lit(True)))
    taken = part("payload", F.lit(start), n if length is None else F.lit(length))
    moved = F.when(n > start, F.col("offset") + start).otherwise(F.col("offset"))
    return df.withColumns({"offset": moved, "payload": taken})


def pad(df: DataFrame, least: int, fill: int = 0) -> DataFrame:
    """Payloads filled with the byte ``fill`` on the right to ``least`` bytes; longer ones stay."""
    padded = F.rpad(F.col("payload"), least, F.lit(bytes([fill])))
    return df.withColumn("payload", F.when(size() < least, padded).otherwise(F.col("payload")))


def split(df: DataFrame, delimiter: str | bytes, keep_delimiter: bool = False, partition_by=STREAM, order_by=ORDER) -> DataFrame:
    """A row for each part between delimiters that is not empty, numbered anew in each stream.

    An empty delimiter leaves payloads whole. Payloads are bytes of any kind: each byte stands for one character of
    ISO 8859-1 while they are split, and goes back. With ``keep_delimiter`` a part keeps the delimiter that ends it.
    """
    if not delimiter:
        return flat_map_bytes(df, lambda p: F.array(p), partition_by, order_by)
    raw = delimiter.encode() if isinstance(delimiter, str) else delimiter
    pattern = "".join(f"\\x{b:02x}" for b in raw)

    def parts(p: Column) -> Column:
        found = F.split(F.decode(p, "ISO-8859-1"), pattern, -1)
        if keep_delimiter:
            found = F.transform(found, lambda x, i: F.when(i < F.size(found) - 1, F.concat(x, F.lit(raw.decode("latin-1")))).otherwise(x))
        return F.transform(F.filter(found, lambda x: x != ""), lambda x: F.encode(x, "ISO-8859-1"))

    return flat_map_bytes(df, parts, partition_by, order_by)


def unbatch(df: DataFrame, chunk: int) -> DataFrame:
    """Payloads in pieces of ``chunk`` bytes, the last of each possibly shorter; ``sequence`` begins at 0 for each
    input, ``offset`` moves along, an empty payload gives no row."""
    n = size()
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(chunk)))
    out = df.select("*", F.posexplode(starts).alias("_k", "_at"))
    return out.withColumns(
        {"payload": part("payload", F.col("_at"), F.lit(chunk)), "offset": F.col("offset") + F.col("_at"), "sequence": F.col("_k").cast("long")}
    ).drop("_k", "_at")


def _gather(df: DataFrame, group: list[str], order_by, delimiter: str) -> DataFrame:
    """One row for each group: payloads in order, the first row's ``sequence`` and ``pts``, sizes."""
    items = F.array_sort(F.collect_list(F.struct(*order_by, F.col("payload").cast("string").alias("_p"))))
    joined = F.array_join(F.transform(items, lambda x: x["_p"]), delimiter).cast("binary")
    return df.groupBy(*group).agg(
        joined.alias("payload"),
        F.count("*").alias("n_buffers"),
        F.min("sequence").alias("first_sequence"),
        F.min_by("pts", F.struct(*order_by)).alias("pts"),
        F.sum(size()).alias("n_bytes"),
    )


def join_with(df: DataFrame, delimiter: str, count: int | None = None, flush_tail: bool = True, partition_by=STREAM, order_by=ORDER, spread: bool = False) -> DataFrame:
    """``count`` payloads in a row joined by ``delimiter`` (all of a stream without ``count``)."""
    if count is None:
        placed = df.withColumn("batch", F.lit(0).cast("long"))
    else:
        placed = stream_index(df, partition_by, order_by, "batch", spread).withColumn("batch", schema.floor_div(F.col("batch"), count))
    out = _gather(placed, [*partition_by, "batch"], order_by, delimiter)
    return out if flush_tail else out.where(F.col("n_buffers") == (count or 0))


def batch_by_count(df: DataFrame, count: int, flush_tail: bool = True, partition_by=STREAM, order_by=ORDER, spread: bool = False) -> DataFrame:
    """``count`` payloads in a row as one; the first one's metadata. ``spread``: see ``stream_index``."""
    return join_with(df, "", count, flush_tail, partition_by, order_by, spread)


concat_by_count = batch_by_count


def _batches(most_count: int | None, most_bytes: int | None, timeout: int | None):
    def make():
        number, count, bytes_, began = 0, 0, 0, None

        def step(n: int, at: int | None) -> tuple:
            nonlocal number, count, bytes_, began
            full = count and (
                (most_count is not None and count >= most_count)
                or (most_bytes is not None and bytes_ >= most_bytes)
                or (timeout is not None and at is not None and began is not None and at - began >= timeout)
            )
            if full:
                number, count, bytes_ = number + 1, 0, 0
            if not count:
                began = at
            count, bytes_ = count + 1, bytes_ + (n or 0)
            return (number,)

        return step

    return make


def batch(df: DataFrame, count: int | None = None, bytes_: int | None = None, timeout: int | None = None, time: str = "pts", partition_by=STREAM, order_by=ORDER) -> DataFrame:
    """Batches that end once they have ``count`` payloads, or ``bytes_`` bytes or more (they may overshoot), or when
    a row comes ``timeout`` or later after their first one."""
    numbered = annotate(df, _batches(count, bytes_, timeout), [size(), F.col(time)], "batch bigint", partition_by, order_by)
    return _gather(numbered, [*partition_by, "batch"], order_by, "")


def _concats(most: int):
    def make():
        number, held, full = 0, 0, False

        def step(n: int) -> tuple:
            nonlocal number, held, full
            n = n or 0
            if full or (held and held + n > most):
                number, held = number + 1, 0
            held += n
            full = held >= most
            return (number,)

        return step

    return make


def concat_by_size(df: DataFrame, most: int, partition_by=STREAM, order_by=ORDER) -> DataFrame:
    """Payloads in a row as one of at most ``most`` bytes; a larger one goes alone. A group ends before a payload
    that would make it too large, and after one that fills it."""
    numbered = annotate(df, _concats(most), [size()], "batch bigint", partition_by, order_by)
    return _gather(numbered, [*partition_by, "batch"], order_by, "")


def chunk(df: DataFrame, chunk_size: int, flush_tail: bool = True, partition_by=STREAM, order_by=ORDER) -> DataFrame:
    """A stream's bytes in chunks of ``chunk_size`` across the borders of its payloads; the tail only if flushed.

    Running byte offsets place every payload; each is cut at the chunks' borders and the cuts of a chunk are put
    together, so only a chunk's bytes meet.
    """
    at = F.coalesce(F.sum(size()).over(W.partitionBy(*partition_by).orderBy(*order_by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = df.where(size() > 0).select(*partition_by, "payload", "pts", at.alias("_at"), size().cast("long").alias("_n"))
    first, last = schema.floor_div(F.col("_at"), chunk_size), schema.floor_div(F.col("_at") + F.col("_n") - 1, chunk_size)
    cut = placed.select("*", F.explode(F.sequence(first, last)).alias("sequence"))
    begin = F.greatest(F.col("sequence") * chunk_size, F.col("_at"))
    end = F.least((F.col("sequence") + 1) * chunk_size, F.col("_at") + F.col("_n"))
    pieces = cut.select(*partition_by, "sequence", begin.alias("_b"), part("payload", begin - F.col("_at"), end - begin).cast("string").alias("_p"))
    items = F.array_sort(F.collect_list(F.struct("_b", "_p")))
    out = pieces.groupBy(*partition_by, "sequence").agg(F.array_join(F.transform(items, lambda x: x["_p"]), "").cast("binary").alias("payload"))
    return out if flush_tail else out.where(size() == chunk_size)
