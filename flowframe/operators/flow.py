"""Several inputs or outputs: funnel, concat, selectors, demultiplexing, tee, synchronised muxing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowframe.operators.filters import state_at
from flowframe.schema import floor_div


def funnel(*inputs: DataFrame) -> DataFrame:
    """All rows of all inputs (their columns matched by name); ``input`` is the number of the input."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("input", F.lit(i)) for i, df in enumerate(inputs)))


def concat(*inputs: DataFrame, skip_to: int = 0) -> DataFrame:
    """Inputs one after the other from number ``skip_to`` on: order by ``input``, then by each one's own order."""
    return funnel(*inputs).where(F.col("input") >= skip_to)


def select_input(inputs: list[DataFrame], active: int) -> DataFrame:
    """The active input; the others are dropped."""
    return inputs[active]


def select_input_log(inputs: list[DataFrame], log: DataFrame, initially: int = 0, time: str = "pts") -> DataFrame:
    """Rows of whichever input ``log`` (``at``, ``active``) selects at their time."""
    return funnel(*inputs).where(F.col("input") == state_at(log, "active", F.col(time), initially))


def select_output(df: DataFrame, n: int, active: Column) -> list[DataFrame]:
    """``n`` outputs; each row goes to the one that ``active`` names."""
    return [df.where(active == i) for i in range(n)]


def demux(df: DataFrame, key: Column, keys: list) -> dict:
    """An output for each of ``keys``: the rows with that key. To split by all keys at once write with ``partitionBy``."""
    return {k: df.where(key == k) for k in keys}


def demux_by_sequence(df: DataFrame, n: int, keys: list | None = None) -> dict:
    """Outputs by ``sequence`` modulo ``n``."""
    return demux(df, F.pmod(F.col("sequence"), F.lit(n)), keys if keys is not None else list(range(n)))


def tee(df: DataFrame, n: int) -> list[DataFrame]:
    """The same rows ``n`` times; persist ``df`` before if it is dear to compute."""
    return [df] * n


def mux(inputs: dict[str, DataFrame], interval: int, first: int | None = None) -> DataFrame:
    """Timed inputs in one stream of slots of ``interval`` nanoseconds, ordered by ``slot``, ``pts``, ``pad``.

    A row's slot is the first one whose target time (first pts plus a multiple of the interval) it does not pass.
    """
    all_ = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("pad", F.lit(name)) for name, df in inputs.items()))
    if first is None:
        base = all_.agg(F.min("pts").alias("_first"))
        all_ = all_.join(F.broadcast(base))  # one row
    else:
        all_ = all_.withColumn("_first", F.lit(first))
    slot = F.greatest(F.lit(0).cast("long"), -floor_div(F.col("_first") - F.col("pts"), interval))
    return all_.withColumn("slot", slot).drop("_first")


def ready_slots(muxed: DataFrame, required: list[str], mode: str = "strict", video: str | None = None, ended: list[str] | None = None) -> DataFrame:
    """Slots that may go out, with their ``pads`` and ``n_buffers``.

    ``strict``: those that every required pad has reached or passed, or has ended before; ``ended`` names the pads that
    have ended, all of them by default, as on bounded input. ``loose``: those with data of the video pad. ``timed``:
    those with any data.
    """
    per_slot = muxed.groupBy("slot").agg(F.array_sort(F.collect_set("pad")).alias("pads"), F.count("*").alias("n_buffers"))
    if mode == "timed":
        return per_slot
    if mode == "loose":
        return per_slot.where(F.array_contains("pads", video or required[0]))
    awaited = [] if ended is None else [p for p in required if p not in ended]
    if not awaited:
        return per_slot
    reached = muxed.where(F.col("pad").isin(awaited)).groupBy("pad").agg(F.max("slot").alias("_reached"))
    # one row; a pad that has sent nothing yet holds every slot back
    edge = reached.agg(F.when(F.count("*") == len(awaited), F.min("_reached")).alias("_edge"))
    return per_slot.join(F.broadcast(edge)).where(F.col("slot") <= F.col("_edge")).drop("_edge")
