"""Timing operators, on event time instead of the clock on the wall: results depend on the data alone."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowframe.plans.scan import annotate
from flowframe.schema import ORDER, STREAM, TIMEOUT


def _throttle(interval: int):
    def make():
        passed = None

        def step(at: int | None) -> tuple:
            nonlocal passed
            if at is not None and (passed is None or at - passed >= interval):
                passed = at
                return (True,)
            return (False,)

        return step

    return make


def throttle(df: DataFrame, interval: int, time: str = "pts", partition_by=STREAM, order_by=ORDER) -> DataFrame:
    """A row passes if it is the first or comes ``interval`` or more after the last that passed; others go."""
    return annotate(df, _throttle(interval), [F.col(time)], "_passed boolean", partition_by, order_by).where("_passed").drop("_passed")


def throttle_rate(df: DataFrame, per_second: float, **how) -> DataFrame:
    return throttle(df, int(1e9 / per_second), **how)


def debounce(df: DataFrame, quiet: int, time: str = "pts", partition_by=STREAM, order_by=ORDER) -> DataFrame:
    """A row passes if nothing follows for ``quiet``; the last of a stream passes."""
    gap = F.lead(time).over(W.partitionBy(*partition_by).orderBy(*order_by)) - F.col(time)
    return df.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") >= quiet)).drop("_gap")


def timeout(df: DataFrame, after: int, payload: bytes = b"", partition_by=STREAM, order_by=ORDER) -> DataFrame:
    """Fallback rows for silences: ``after``, twice ``after``... past a row, before the next one comes.

    They have the TIMEOUT flag; nothing comes before a stream's first row or after its last.
    """
    following = F.lead("pts").over(W.partitionBy(*partition_by).orderBy(*order_by))
    silent = df.select(*partition_by, "pts", following.alias("_next")).where(F.col("_next") - F.col("pts") > after)
    points = F.sequence(F.col("pts") + after, F.col("_next") - 1, F.lit(after).cast("long"))
    return silent.select(*partition_by, F.explode(points).alias("pts"), F.lit(TIMEOUT).alias("flags"), F.lit(payload).alias("payload"))


def _departure(arrival: Column, service: int, partition_by, order_by) -> Column:
    """Departures of a queue with a fixed service time, closed: i * d + max over j <= i of (a_j - j * d)."""
    w = W.partitionBy(*partition_by).orderBy(*order_by)
    i = F.row_number().over(w).cast("long")
    slack = arrival - i * F.lit(service).cast("long")
    return i, slack, w


def rate_limit(df: DataFrame, interval: int, time: str = "pts", partition_by=STREAM, order_by=ORDER) -> DataFrame:
    """``departure`` of each row: at its time, or ``interval`` after the departure before, whichever is later."""
    i, slack, w = _departure(F.col(time), interval, partition_by, order_by)
    ranked = df.withColumns({"_i": i, "_slack": slack})
    latest = F.max("_slack").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return ranked.withColumn("departure", F.col("_i") * F.lit(interval).cast("long") + latest).drop("_i", "_slack")


def rate_limit_per_second(df: DataFrame, per_second: float, **how) -> DataFrame:
    return rate_limit(df, int(1e9 / per_second), **how)


def delay(df: DataFrame, by: int, time: str = "pts", partition_by=STREAM, order_by=ORDER) -> DataFrame:
    """``departure`` of each row when each in turn is held for ``by``, so that arrivals queue up."""
    i, slack, w = _departure(F.col(time), by, partition_by, order_by)
    ranked = df.withColumns({"_i": i, "_slack": slack})
    latest = F.max("_slack").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return ranked.withColumn("departure", (F.col("_i") + 1) * F.lit(by).cast("long") + latest).drop("_i", "_slack")


def _byte_rate(rate: int):
    def make():
        clock, began, sent = None, None, 0

        def step(at: int, n: int) -> tuple:
            nonlocal clock, began, sent
            now = at if clock is None else max(at, clock)
            if began is None or now - began >= 1_000_000_000:
                began, sent = now, 0
            if sent + n > rate:
                now += max(0, sent + n - rate) * 1_000_000_000 // rate
                began, sent = now, n
            else:
                sent += n
            clock = now
            return (now,)

        return step

    return make


def rate_limit_bytes(df: DataFrame, per_second: int, time: str = "pts", partition_by=STREAM, order_by=ORDER) -> DataFrame:
    """``departure`` under a budget of bytes for each second: a row that exceeds it waits for the excess at the rate,
    and the new second begins with it."""
    return annotate(df, _byte_rate(per_second), [F.col(time), F.octet_length("payload")], "departure bigint", partition_by, order_by)


def _queue(most: int, service: int, leaky: str, most_bytes: int | None):
    def make():
        waiting: deque[tuple[int, int, int]] = deque()
        held, free_at, number = 0, None, -1

        def hand_on(now: int) -> None:
            nonlocal held, free_at
            came, _, n = waiting.popleft()
            held -= n
            free_at = max(came, now if free_at is None else free_at) + service

        def full() -> bool:
            return len(waiting) >= most or (most_bytes is not None and held >= most_bytes)

        def step(at: int, n: int | None) -> tuple:
            nonlocal held, number
            number += 1
            n = n or 0
            while waiting and (free_at is None or free_at <= at):
                hand_on(at)
            evicted: list[int] = []
            now = at
            while waiting and full():
                if leaky == "upstream":
                    return (len(waiting), "dropped", None, [], None)
                if leaky == "none":
                    now = max(now, free_at)
                    hand_on(now)
                    continue
                _, gone, size = waiting.popleft()
                held -= size
                evicted.append(gone)
            waiting.append((now, number, n))
            held += n
            return (len(waiting), "queued", evicted[-1] if evicted else None, evicted, now)

        return step

    return make


def queue(
    df: DataFrame, most: int, service: int, leaky: str = "upstream", time: str = "pts", partition_by=STREAM, order_by=ORDER, most_bytes: int | None = None
) -> DataFrame:
    """A simulated bounded queue that hands on a row each ``service``: its ``depth`` after each arrival, and what is
    dropped when it is full: the new row (``leaky`` upstream) or the oldest ones (downstream; ``all_evicted`` are their
    places, ``evicted`` the last of them). With ``leaky`` none the row waits for space: ``entered`` is when it gets in.

    It is full at ``most`` rows or, if given, ``most_bytes`` of payloads; an empty queue takes any row.
    """
    outputs = "depth int, outcome string, evicted bigint, all_evicted array<bigint>, entered bigint"
    return annotate(df, _queue(most, service, leaky, most_bytes), [F.col(time), F.octet_length("payload")], outputs, partition_by, order_by)


def hysteresis(df: DataFrame, level: str, capacity: int, high: float = 0.8, low: float = 0.2, partition_by=STREAM, order_by=ORDER) -> DataFrame:
    """``busy``: from a level of ``high`` of the capacity on until one of ``low`` or less."""
    edge = F.when(F.col(level) >= capacity * high, True).when(F.col(level) <= capacity * low, False)
    w = W.partitionBy(*partition_by).orderBy(*order_by).rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = df.withColumn("_edge", edge)
    return marked.withColumn("busy", F.coalesce(F.last("_edge", ignorenulls=True).over(w), F.lit(False))).drop("_edge")


def running_time(df: DataFrame, partition_by=STREAM) -> DataFrame:
    """``running``: pts since the stream's first."""
    return df.withColumn("running", F.col("pts") - F.min("pts").over(W.partitionBy(*partition_by)))
