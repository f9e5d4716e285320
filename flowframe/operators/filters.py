"""Filters on buffers: predicates, samples, ranges, patterns, duplicates, a valve."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowframe.plans.scan import annotate, stream_index
from flowframe.schema import ORDER, STREAM

#: Seed of the exact random sample (fixed value).
XORSHIFT_SEED = 0x853C49E6748FEA9B


def size(column: str = "payload") -> Column:
    return F.octet_length(column)


def predicate(df: DataFrame, keep: Column, observation: Observation | None = None) -> DataFrame:
    """Rows for which ``keep`` is true; an observation gets how many passed and were dropped."""
    kept = F.coalesce(keep, F.lit(False))
    if observation is not None:
        df = df.observe(observation, F.count_if(kept).alias("passed"), F.count_if(~kept).alias("dropped"))
    return df.where(kept)


def every_nth(df: DataFrame, n: int, partition_by=STREAM, order_by=ORDER, spread: bool = False) -> DataFrame:
    """Rows 0, n, 2n... of each stream; ``n`` below 1 counts as 1. ``spread``: see ``stream_index``."""
    return stream_index(df, partition_by, order_by, "_i", spread).where(F.col("_i") % max(n, 1) == 0).drop("_i")


def first_n(df: DataFrame, n: int, partition_by=STREAM, order_by=ORDER) -> DataFrame:
    """The first ``n`` rows of each stream; each task keeps no more of a stream before the shuffle."""
    nth = F.row_number().over(W.partitionBy(*partition_by).orderBy(*order_by))
    return df.withColumn("_nth", nth).where(F.col("_nth") <= n).drop("_nth")


def skip_first(df: DataFrame, n: int, partition_by=STREAM, order_by=ORDER, spread: bool = False) -> DataFrame:
    return stream_index(df, partition_by, order_by, "_i", spread).where(F.col("_i") >= n).drop("_i")


def random_percent(df: DataFrame, percent: float, seed: int = 42) -> DataFrame:
    """About ``percent`` of the rows, chosen independently."""
    return df.where(F.rand(seed) * 100 < percent)


def _xorshift(seed: int, percent: int):
    def make():
        state = seed or 1

        def step() -> tuple:
            nonlocal state
            state ^= (state << 13) & 0xFFFFFFFFFFFFFFFF
            state ^= state >> 7
            state ^= (state << 17) & 0xFFFFFFFFFFFFFFFF
            return (state % 100 < percent,)

        return step

    return make


def random_percent_exact(df: DataFrame, percent: int, seed: int = XORSHIFT_SEED, partition_by=STREAM, order_by=ORDER) -> DataFrame:
    """The sample that a 64-bit xorshift generator (shifts 13, 7, 17), advanced by each row, draws from each stream."""
    return annotate(df, _xorshift(seed, percent), [], "_kept boolean", partition_by, order_by).where("_kept").drop("_kept")


def by_metadata(df: DataFrame, stream_id: int | None = None, min_sequence: int | None = None, max_sequence: int | None = None) -> DataFrame:
    """Rows of a stream and a range of sequence numbers, both ends included; unset means any."""
    if stream_id is not None:
        df = df.where(F.col("stream_id") == stream_id)
    if min_sequence is not None:
        df = df.where(F.col("sequence") >= min_sequence)
    if max_sequence is not None:
        df = df.where(F.col("sequence") <= max_sequence)
    return df


def by_size(df: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Payloads of ``low`` to ``high`` bytes, both included."""
    if low is not None:
        df = df.where(size() >= low)
    return df if high is None else df.where(size() <= high)


def by_sequence(df: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    return by_metadata(df, None, low, high)


def by_regex(df: DataFrame, pattern: str, inverted: bool = False, column: str = "payload") -> DataFrame:
    """Payloads whose text matches ``pattern`` somewhere (or nowhere, if ``inverted``).

    Bytes that are not UTF-8 count as U+FFFD. Patterns are linear-time ones: look-around and back-references are refused. Classes such as ``\\d`` take in
    all of Unicode.
    """
    if re.search(r"\(\?(=|!|<=|<!)|\\[1-9]", pattern):
        raise ValueError(f"pattern with look-around or back-reference: {pattern}")
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"invalid pattern: {pattern}") from e
    found = F.make_valid_utf8(F.col(column).cast("binary").cast("string")).rlike(f"(?U){pattern}")
    return df.where(~found if inverted else found)


def drop_duplicates(df: DataFrame, content: str = "payload", partition_by=(), order_by=ORDER) -> DataFrame:
    """The first row of each content stays, in each group of ``partition_by`` (of rows without content, the first too).

    A minimum over the order columns by the content's SHA-256, combined before the shuffle, finds the first rows:
    what is dealt is 32 bytes a row whatever the content's size, and a content that very many rows share costs one
    row from each task. ``order_by`` has to be unique within a stream; of rows equal in it, that of the least
    ``stream_id`` comes first. Null keys are a group of their own, and null places come first.
    """
    ties = [c for c in STREAM if c in df.columns and c not in partition_by and c not in order_by]
    place = F.struct(*order_by, *ties)
    digest = F.unhex(F.sha2(F.col(content).cast("binary"), 256))
    keyed = df.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(partition_by)), digest.alias("_of"), place.alias("_p"))
    keys = [f"_k{i}" for i in range(len(partition_by))]
    first = keyed.groupBy(*keys, "_of").agg(F.min("_p").alias("_first"))
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(partition_by, keys)]
    same += [F.col(c).eqNullSafe(F.col("_first")[c]) for c in (*order_by, *ties)]
    return df.withColumn("_digest", digest).join(first, [F.col("_digest").eqNullSafe(F.col("_of")), *same], "left_semi").drop("_digest")


def valve(df: DataFrame, is_open: bool = True) -> DataFrame:
    return df if is_open else df.where(F.lit(False))


#: Most changes in a control log: logs are written by hand or by an operator's console, and go into an expression.
MOST_CHANGES = 10_000


def state_at(log: DataFrame, state: str, time: Column, initially) -> Column:
    """The ``state`` of the last change in ``log`` (``at``, state) at or before ``time``; ``initially`` before the first.

    The log's size is checked; a longer one belongs in an as-of join.
    """
    changes = log.select("at", state).where("at is not null").orderBy("at").limit(MOST_CHANGES + 1).collect()
    if len(changes) > MOST_CHANGES:
        raise ValueError(f"a control log has at most {MOST_CHANGES} changes")
    if not changes:
        return F.lit(initially)
    at, states = F.lit([r["at"] for r in changes]), F.lit([r[state] for r in changes])
    passed = F.size(F.filter(at, lambda a: a <= time))
    return F.when(passed == 0, F.lit(initially)).otherwise(F.element_at(states, F.greatest(passed, F.lit(1))))


def valve_log(df: DataFrame, log: DataFrame, initially: bool = True, time: str = "pts") -> DataFrame:
    """Rows that come while the valve is open by ``log`` (``at`` times and ``open`` states)."""
    return df.where(state_at(log, "open", F.col(time), initially))
