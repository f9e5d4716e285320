"""Small things that the operators on documents share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import sys

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_integer(docs: DataFrame, column: str = "doc_id") -> None:
    """Ids are whole numbers (or null): others, which a cast could change, are refused before anything runs."""
    if not isinstance(docs.schema[column].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise ValueError(f"{column} must be of an integer type, not {docs.schema[column].dataType.simpleString()}")


def with_row(docs: DataFrame, text_back: bool = False) -> DataFrame:
    """``row``, a struct of the columns as they came, so that what an operator adds can never clash with them.

    With ``text_back`` the struct holds the text too; else the text (as a string) is a column of its own and ends
    with the Python stage, so it is sent one way only.
    """
    text = docs["text"].cast("string").alias("text")
    if text_back:
        return docs.select(F.struct(*(text if c == "text" else docs[c] for c in docs.columns)).alias("row"))
    rest = [docs[c] for c in docs.columns if c != "text"] or [F.lit(0).alias("none")]
    return docs.select(F.struct(*rest).alias("row"), text)


def texts_of(batch: pa.RecordBatch) -> pa.Array:
    """The texts of a batch that :func:`with_row` has laid out."""
    return batch.column("text") if "text" in batch.schema.names else batch.column("row").field("text")


def frugal(run):
    """For functions of ``mapInArrow``: give memory back before and after a task, for Spark keeps its Python workers.

    Before it the worker's vocabularies and what it remembers of them go, which only other stages need; then what
    the allocators hold without use goes back to the system.
    """

    @functools.wraps(run)
    def bounded(batches):
        tokens = sys.modules.get("flowframe.llm.tokens")
        if tokens is not None:
            tokens._ENCODERS.clear()
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return bounded


def tidy(run):
    """As :func:`frugal`, for stages that use a vocabulary: it stays loaded for the worker's next task."""

    @functools.wraps(run)
    def bounded(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return bounded


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such function
        ctypes.CDLL(None).malloc_trim(0)


def replace_text(df: DataFrame, columns: list[str], new: str) -> DataFrame:
    """The ``columns`` out of ``row`` with the text in column ``new``; ``n_chars``, if there, follows a changed text."""
    changed = ~F.col(new).eqNullSafe(F.col("row")["text"])
    out = []
    for c in columns:
        old = F.col("row")[c]
        if c == "text":
            out.append(F.col(new).alias(c))
        elif c == "n_chars":
            out.append(F.when(changed, F.length(new).cast("long")).otherwise(old).alias(c))
        else:
            out.append(old.alias(c))
    return df.select(*out)
