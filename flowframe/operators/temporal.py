"""Joins of timed streams: exact, within a tolerance, nearest, as-of and interpolating; watermarks on bounded input.

Both sides have a time column (a number in one unit) and unique order columns. Where a strategy consumes what it
matches, the matching is sequential along time and runs in the ordered scan of each key.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowframe.plans.scan import annotate
from flowframe.schema import floor_div

#: Defaults in nanoseconds (fixed values): tolerance and longest delay of the join window.
TOLERANCE, MAX_DELAY = 10_000_000, 100_000_000


def _sided(left: DataFrame, right: DataFrame, time: str, by) -> DataFrame:
    """Both sides in one frame: keys, ``_t``, ``_side``, and each side's row as a struct."""
    kinds = [T.StructType([*df.schema.fields]) for df in (left, right)]
    rows = []
    for side, df in ((0, left), (1, right)):
        own = F.struct(*(F.col(c) for c in df.columns))
        other = F.lit(None).cast(kinds[1 - side])
        columns = (own, other) if side == 0 else (other, own)
        rows.append(df.select(*by, F.col(time).cast("long").alias("_t"), F.lit(side).alias("_side"), columns[0].alias("left"), columns[1].alias("right")))
    return rows[0].unionByName(rows[1])


def exact(left: DataFrame, right: DataFrame, time: str, left_order: str, right_order: str, by=()) -> DataFrame:
    """Full outer join on equal times, one to one: the k-th left row of a time with its k-th right row.

    ``outcome``: matched, left_only or right_only; ``left`` and ``right`` are the rows.
    """
    keys = [*by, time]

    def ranked(df: DataFrame, order: str, name: str) -> DataFrame:
        k = F.row_number().over(W.partitionBy(*keys).orderBy(order))
        return df.select(*keys, k.alias("_k"), F.struct(*df.columns).alias(name))

    a, b = ranked(left, left_order, "left"), ranked(right, right_order, "right")
    joined = a.join(b, [*keys, "_k"], "full_outer")
    outcome = F.when(F.col("right").isNull(), "left_only").when(F.col("left").isNull(), "right_only").otherwise("matched")
    return joined.select(*keys, "left", "right", outcome.alias("outcome"))


def tolerance_pairs(left: DataFrame, right: DataFrame, time: str, tolerance: int, by=()) -> DataFrame:
    """All pairs within ``tolerance``: an equi-join on buckets of time as wide as the tolerance, then the check.

    Right rows go to their own bucket and its two neighbours, so a left row meets each candidate once.
    """
    width = max(int(tolerance), 1)
    a = left.select(*by, F.col(time).cast("long").alias("_lt"), floor_div(F.col(time).cast("long"), width).alias("_b"), F.struct(*left.columns).alias("left"))
    b = right.select(*by, F.col(time).cast("long").alias("_rt"), F.struct(*right.columns).alias("right"))
    b = b.select("*", F.explode(F.array(*(floor_div(F.col("_rt"), width) + d for d in (-1, 0, 1)))).alias("_b"))
    near = F.abs(F.col("_lt") - F.col("_rt")) <= tolerance
    return a.join(b, [*by, "_b"]).where(near).drop("_b", "_lt", "_rt")


def _greedy(tolerance: int, nearest: bool):
    """Two sides in order of time: left rows wait until no better right row can come, and consume what they match.

    Right rows lie in lists by time; ``after`` and ``before`` point past those taken, with the paths shortened as they
    are walked, so that a row costs a binary search. What no later left row can reach goes when it is half of all.
    """

    def make():
        lefts: deque[tuple[int, int]] = deque()
        times: list[int] = []
        numbers: list[int] = []
        after: list[int] = [0]
        before: list[int] = [0]
        counts = [0, 0]

        def end_of(links: list[int], i: int) -> int:
            end = i
            while links[end] != end:
                end = links[end]
            while links[i] != end:
                links[i], i = end, links[i]
            return end

        def add(at: int, number: int) -> None:
            # place k of the right rows is k + 1 in ``before``, whose 0 stands for none
            times.append(at)
            numbers.append(number)
            after.append(len(times))
            before.append(len(times))

        def first_from(i: int) -> int:
            return end_of(after, i)

        def taken(k: int) -> int:
            after[k], before[k + 1] = k + 1, k
            return numbers[k]

        def best(at: int) -> int | None:
            k = first_from(bisect_left(times, at - tolerance))
            if k == len(times) or times[k] > at + tolerance:
                return None
            if not nearest:
                return k
            right = first_from(bisect_left(times, at))
            left = end_of(before, bisect_left(times, at)) - 1
            if left < 0 or times[left] < at - tolerance:
                return right
            if right == len(times) or at - times[left] <= times[right] - at:
                return first_from(bisect_left(times, times[left]))
            return right

        def forget(edge: int) -> None:
            cut = bisect_left(times, edge)
            if 2 * cut <= len(times) or cut < 64:
                return
            kept = [(times[k], numbers[k]) for k in range(cut, len(times)) if after[k] == k]
            for x in (times, numbers):
                x.clear()
            after[:], before[:] = [0], [0]
            for at, number in kept:
                add(at, number)

        def settle(now: int | None) -> list[tuple[int, int]]:
            pairs = []
            while lefts and (now is None or now > lefts[0][0] + tolerance):
                at, number = lefts.popleft()
                k = best(at)
                if k is not None:
                    pairs.append((number, taken(k)))
            edge = lefts[0][0] if lefts else now
            if edge is not None:
                forget(edge - tolerance)
            return pairs

        def step(at: int, side: int, last: bool) -> tuple:
            pairs = settle(at)
            if side:
                add(at, counts[1])
            else:
                lefts.append((at, counts[0]))
            counts[side] += 1
            if last:
                pairs += settle(None)
            return ([{"l": x, "r": y} for x, y in pairs],)

        return step

    return make


def _matched(left: DataFrame, right: DataFrame, time: str, by, order_by, tolerance: int, nearest: bool) -> DataFrame:
    """The scan sees times only and tells places within a key; the rows join by these, which windows count alike.

    Rows without a time match nothing.
    """
    keys = list(by)
    packed = [f"_k{i}" for i in range(len(keys))]

    def placed(df: DataFrame, order: str, name: str) -> DataFrame:
        rows = df.where(F.col(time).isNotNull()).select(*(F.col(k).alias(p) for k, p in zip(keys, packed)), F.col(time).cast("long").alias("_t"), F.col(order).alias("_o"), F.struct(*df.columns).alias(name))
        w = W.partitionBy(*(packed or [F.lit(0)])).orderBy("_t", "_o")
        return rows.withColumn("_n", F.row_number().over(w).cast("long") - 1)

    a, b = placed(left, order_by[0], "left"), placed(right, order_by[1], "right")
    both = a.select(*packed, "_t", "_n", F.lit(0).alias("_side")).unionByName(b.select(*packed, "_t", "_n", F.lit(1).alias("_side")))
    sort = ("_t", "_side", "_n")
    w = W.partitionBy(*(packed or [F.lit(0)])).orderBy(*sort)
    marked = both.withColumn("_last", F.lead("_t").over(w).isNull())
    scanned = annotate(marked, _greedy(tolerance, nearest), [F.col("_t"), F.col("_side"), F.col("_last")], "_pairs array<struct<l:bigint,r:bigint>>", packed, sort)
    pairs = scanned.select(*packed, F.explode("_pairs").alias("_p")).select(*packed, "_p.l", "_p.r")

    def same(x: DataFrame, y: DataFrame, place: str):
        on = y["_n"] == x[place]
        for p in packed:
            on = on & x[p].eqNullSafe(y[p])
        return on

    joined = pairs.join(a, same(pairs, a, "l")).select(*(pairs[p] for p in packed), "r", "left")
    joined = joined.join(b, same(joined, b, "r")).select(*(joined[p] for p in packed), "left", "right")
    return joined.select(*(F.col(p).alias(k) for k, p in zip(keys, packed)), "left", "right")


def tolerance(left: DataFrame, right: DataFrame, time: str, within: int = TOLERANCE, by=(), order_by=("sequence", "sequence")) -> DataFrame:
    """One to one: each left row, in order of time, takes the first right row not yet taken within ``within``."""
    return _matched(left, right, time, by, order_by, within, False)


def nearest(left: DataFrame, right: DataFrame, time: str, within: int = TOLERANCE, by=(), order_by=("sequence", "sequence")) -> DataFrame:
    """One to one: each left row, in order of time, takes the nearest right row not yet taken within ``within``;
    of two equally near the earlier."""
    return _matched(left, right, time, by, order_by, within, True)


def _around(left: DataFrame, right: DataFrame, time: str, by, values: list[str]) -> DataFrame:
    """Left rows with the right rows before (or at) and after (or at) their time, by two windows over the union."""
    both = _sided(left, right, time, by)
    keys = list(by)
    base = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    kept = F.when(F.col("_side") == 1, F.struct(F.col("_t").alias("t"), *(F.col("right")[v].alias(v) for v in values)))
    # at equal times right rows come before for the one window and, in the reverse order, for the other
    before = F.last(kept, ignorenulls=True).over(base.orderBy(F.col("_t"), F.col("_side").desc()).rowsBetween(W.unboundedPreceding, W.currentRow))
    after = F.last(kept, ignorenulls=True).over(base.orderBy(F.col("_t").desc(), F.col("_side").desc()).rowsBetween(W.unboundedPreceding, W.currentRow))
    return both.select(*keys, "_t", "_side", "left", before.alias("before"), after.alias("after")).where("_side = 0")


def asof(left: DataFrame, right: DataFrame, time: str, values: list[str], by=(), direction: str = "backward") -> DataFrame:
    """Left rows with ``values`` of the last right row at or before their time (``backward``), the next one at or
    after it (``forward``), or the nearer of the two (``nearest``; the earlier if equally near). One shuffle.

    ``right_time`` is null where there is none. Of several right rows at one time any one may be taken.
    """
    found = _around(left, right, time, by, values)
    near = F.when(F.col("after").isNull(), F.col("before")).when(F.col("before").isNull(), F.col("after"))
    near = near.when(F.col("after.t") - F.col("_t") < F.col("_t") - F.col("before.t"), F.col("after")).otherwise(F.col("before"))
    chosen = {"backward": F.col("before"), "forward": F.col("after"), "nearest": near}[direction]
    out = found.select("left", chosen.alias("m"))
    return out.select("left.*", F.col("m.t").alias("right_time"), *(F.col("m")[v].alias(f"right_{v}") for v in values))


def interpolate(left: DataFrame, right: DataFrame, time: str, value: str, by=(), within: int | None = None) -> DataFrame:
    """Left rows with the right side's ``value`` at their time, on the line between the right rows around it.

    Null where there is no right row on one of the sides, or where the two are further than ``within`` apart.
    """
    found = _around(left, right, time, by, [value])
    t0, t1, v0, v1 = F.col("before.t"), F.col("after.t"), F.col("before")[value], F.col("after")[value]
    line = F.when(t1 == t0, v0.cast("double")).otherwise(v0 + (v1 - v0) * (F.col("_t") - t0) / (t1 - t0))
    if within is not None:
        line = F.when(t1 - t0 <= within, line)
    return found.select("left.*", line.alias(f"interpolated_{value}"))


def late_rows(left: DataFrame, right: DataFrame, time: str, max_delay: int = MAX_DELAY, by=(), arrival: str = "sequence") -> DataFrame:
    """Both sides in order of ``arrival`` with the ``watermark`` (greatest time so far on either side, less
    ``max_delay``) and whether the row is ``late``."""
    both = _sided(left, right, time, by)
    keys = list(by)
    base = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    order = F.coalesce(F.col("left")[arrival], F.col("right")[arrival])
    mark = F.max("_t").over(base.orderBy(order, "_side").rowsBetween(W.unboundedPreceding, W.currentRow)) - max_delay
    return both.withColumn("watermark", mark).withColumn("late", F.col("_t") < F.col("watermark"))


def temporal_join(left: DataFrame, right: DataFrame, time: str, within: int, by=(), order_by=("sequence", "sequence")) -> DataFrame:
    """The inner join of the typed API: matches of :func:`tolerance` only."""
    return tolerance(left, right, time, within, by, order_by)
