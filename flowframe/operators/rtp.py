"""Packet streams: extended sequence numbers, reordering, losses, interarrival jitter, sender counts."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowframe.plans.scan import annotate, annotate_spread, spread_before
from flowframe.schema import ORDER, STREAM, floor_div


def timestamp_to_clock(ts: Column, rate: int = 90_000) -> Column:
    """Ticks of a media clock in nanoseconds."""
    return (ts.cast("decimal(38,0)") * 1_000_000_000 / rate).cast("long")


def clock_to_timestamp(ns: Column, rate: int = 90_000) -> Column:
    """Nanoseconds in ticks, wrapped to 32 bits."""
    return F.pmod((ns.cast("decimal(38,0)") * rate / 1_000_000_000).cast("long"), F.lit(1 << 32))


def next_seq(seq: Column) -> Column:
    return (seq + 1) % 65536


def is_next_seq(seq: Column, last: Column) -> Column:
    return seq == next_seq(last)


class Lift:
    """What the numbers of a range of packets, of ``bits`` bits, make of any extended highest number before them.

    A number less than half the circle ahead becomes the highest. So the highest afterwards is a function of the one
    before that never falls and adds a whole circle where the other adds one, and is kept as pieces over one circle:
    piece i begins at ``lo[i]``; there it is ``low[i]``, and stays that (``flat``) or goes up with the argument.
    """

    def __init__(self, bits: int) -> None:
        self.circle = 1 << bits
        self.first: int | None = None
        self.lo, self.low, self.flat = [0], [0], [False]

    def add(self, numbers: np.ndarray) -> None:
        if self.first is None:
            self.first = int(numbers[0])
        for number in _ends_of_runs(numbers, self.circle):
            self._step(number)

    def _step(self, number: int) -> None:
        target = number + ((self.low[0] - number) // self.circle + 1) * self.circle
        for b in (target, target + self.circle):
            # values strictly between a and b go to b
            a = b - self.circle // 2
            i = bisect_right(self.low, a)
            if i and not self.flat[i - 1] and self._top(i - 1) > a:
                self._split(i - 1, a + 1)
            j = bisect_left(self.low, b)
            if j > i and not self.flat[j - 1] and self._top(j - 1) >= b:
                self._split(j - 1, b)
            if j > i:
                # a constant that follows with the same value is the same piece
                k = j + 1 if j < len(self.low) and self.flat[j] and self.low[j] == b else j
                self.lo[i:k], self.low[i:k], self.flat[i:k] = [self.lo[i]], [b], [True]

    def _top(self, i: int) -> int:
        return (self.lo[i + 1] if i + 1 < len(self.lo) else self.circle) - 1

    def _split(self, i: int, at: int) -> None:
        self.lo.insert(i + 1, at)
        self.low.insert(i + 1, at)
        self.flat.insert(i + 1, False)

    def after(self, highest: int | None) -> int:
        """The extended highest number after the packets; ``None``: they are the stream's first."""
        if highest is None:
            highest = self.first
        at = highest % self.circle
        i = bisect_right(self.lo, at) - 1
        return highest - at + (self.low[i] if self.flat[i] else at)


def _ends_of_runs(numbers: np.ndarray, circle: int) -> list[int]:
    """The numbers without those inside stretches that go up by less than half the circle in all: of such a stretch the
    first and the last do the same."""
    ahead = (numbers[1:] - numbers[:-1]) & (circle - 1)
    stretch = np.cumsum(ahead) // max(circle // 4, 1)
    cut = (ahead >= circle // 4) | (np.diff(stretch, prepend=0) != 0)
    keep = np.ones(len(numbers), dtype=bool)
    keep[1:-1] = cut[:-1] | cut[1:]
    return numbers[keep].tolist()


class Extended:
    """The number with its wraps; state: the extended highest number so far. Null numbers stay null and change nothing."""

    def __init__(self, bits: int, name: str) -> None:
        self.bits, self.circle, self.outputs = bits, 1 << bits, f"{name} bigint"

    def _numbers(self, columns: list) -> tuple[np.ndarray, np.ndarray]:
        there = columns[0].is_valid().to_numpy(zero_copy_only=False)
        return there, columns[0].drop_null().to_numpy() & (self.circle - 1)

    def summarise(self, columns: list, summary: Lift | None) -> Lift | None:
        numbers = self._numbers(columns)[1]
        if len(numbers):
            summary = summary or Lift(self.bits)
            summary.add(numbers)
        return summary

    def carry(self, state: int | None, summary: Lift | None) -> int | None:
        return summary.after(state) if summary else state

    def run(self, columns: list, state: int | None) -> tuple[list, int | None]:
        there, numbers = self._numbers(columns)
        if not len(numbers):
            return [pa.nulls(len(there), pa.int64())], state
        extended, state = self._extend(numbers, int(numbers[0]) if state is None else state)
        # behind the first number but before any wrap
        extended = np.where(extended < 0, extended + self.circle, extended)
        out = np.zeros(len(there), dtype=np.int64)
        out[there] = extended
        return [pa.array(out, mask=~there)], state

    def _extend(self, numbers: np.ndarray, highest: int) -> tuple[np.ndarray, int]:
        half, last = self.circle // 2, self.circle - 1
        if len(numbers) > 16:
            # each number nearest to the one before it, which is right where all are within half a circle of the highest
            steps = ((np.diff(numbers, prepend=highest & last) + half) & last) - half
            near = highest + np.cumsum(steps)
            most = np.maximum(np.maximum.accumulate(near), highest)
            apart = near - np.concatenate(([highest], most[:-1]))
            if (apart >= -half).all() and (apart < half).all():
                return near, int(most[-1])
        found = []
        for number in numbers.tolist():
            ahead = (number - highest) & last
            if ahead < half:
                highest += ahead
                found.append(highest)
            else:
                found.append(highest + ahead - self.circle)
        return np.array(found, dtype=np.int64), highest


def extend_sequence(df: DataFrame, seq: str = "seq", partition_by=STREAM, order_by=ORDER) -> DataFrame:
    """``ext_seq``: the 16-bit ``seq`` with its number of wraps, in order of arrival; several tasks share a long stream."""
    return annotate_spread(df, Extended(16, "ext_seq"), [F.col(seq).cast("long")], partition_by, order_by)


def extend_timestamp(df: DataFrame, ts: str = "rtp_ts", partition_by=STREAM, order_by=ORDER) -> DataFrame:
    """``ext_ts``: the 32-bit media time ``ts`` with its number of wraps, as receivers unwrap it, in order of arrival.

    Streams of one clock whose first packets may come after a wrap are extended together, without ``partition_by``.
    """
    return annotate_spread(df, Extended(32, "ext_ts"), [F.col(ts).cast("long")], partition_by, order_by)


class Falls:
    """The number with its wraps where a fall of more than half the range is one; state: the last number, the wraps so far."""

    outputs = "ext_seq bigint"

    def _steps(self, columns: list, last: int | None) -> tuple[np.ndarray, np.ndarray, int | None]:
        there = columns[0].is_valid().to_numpy(zero_copy_only=False)
        # a null is no fall, to it or from it
        numbers = pc.fill_null(columns[0], -1).to_numpy()
        before = np.concatenate(([-1 if last is None else last], numbers[:-1]))
        return numbers, (before - numbers > 0x8000) & there, int(numbers[-1]) if there[-1] else None

    def summarise(self, columns: list, summary: tuple | None) -> tuple:
        first, last, wraps = summary or (columns[0][0].as_py(), None, 0)
        _, falls, last = self._steps(columns, last)
        return first, last, wraps + int(falls.sum())

    def carry(self, state: tuple | None, summary: tuple | None) -> tuple | None:
        if not state or not summary:
            return summary[1:] if summary else state
        (before, wraps), (first, last, more) = state, summary
        fall = before is not None and first is not None and before - first > 0x8000
        return last, wraps + more + fall

    def run(self, columns: list, state: tuple | None) -> tuple[list, tuple]:
        last, wraps = state or (None, 0)
        numbers, falls, last = self._steps(columns, last)
        cycles = wraps + np.cumsum(falls)
        return [pa.array(cycles * 65536 + numbers, mask=columns[0].is_null().to_numpy(zero_copy_only=False))], (last, int(cycles[-1]))


def extend_sequence_in_order(df: DataFrame, seq: str = "seq", partition_by=STREAM, order_by=ORDER) -> DataFrame:
    """``ext_seq`` for streams without reordering over a wrap: a fall of more than half the range is a wrap."""
    return annotate_spread(df, Falls(), [F.col(seq).cast("long")], partition_by, order_by)


def reorder(df: DataFrame, ext_seq: str = "ext_seq", drop_late: bool = False, window: int = 512, partition_by=STREAM, order_by=ORDER) -> DataFrame:
    """What a jitter buffer lets through: the first of each number, in order of number, with ``lost_before`` (numbers
    missing since the one before) and ``reordered`` (it came after a higher number).

    A packet more than ``window`` numbers behind the highest so far is ``late``; with ``drop_late`` it goes. Several
    tasks share a long stream, in order of arrival and then in order of number.
    """
    marked = spread_before(df, ext_seq, "_high", partition_by, order_by, highest=True)
    marked = marked.withColumn("reordered", F.coalesce(F.col(ext_seq) < F.col("_high"), F.lit(False)))
    marked = marked.withColumn("late", F.coalesce(F.col("_high") - F.col(ext_seq) > window, F.lit(False))).drop("_high")
    if drop_late:
        marked = marked.where(~F.col("late"))
    first = marked.withColumn("_nth", F.row_number().over(W.partitionBy(*partition_by, ext_seq).orderBy(*order_by))).where("_nth = 1").drop("_nth")
    placed = spread_before(first, ext_seq, "_before", partition_by, (ext_seq,))
    return placed.withColumn("lost_before", F.coalesce(F.col(ext_seq) - F.col("_before") - 1, F.lit(0))).drop("_before")


def loss_info(df: DataFrame, ext_seq: str = "ext_seq", partition_by=STREAM, order_by=ORDER) -> DataFrame:
    """Per stream: expected (from the first number to the highest), received (with duplicates), lost, and the lost
    fraction in 256ths, at most 255."""
    base = F.min_by(ext_seq, F.struct(*order_by))
    sums = df.groupBy(*partition_by).agg((F.max(ext_seq) - base + 1).alias("expected"), F.count("*").alias("received"))
    lost = F.greatest(F.lit(0), F.col("expected") - F.col("received"))
    fraction = F.when(F.col("expected") > 0, F.least(F.floor(lost * 256 / F.col("expected")), F.lit(255))).otherwise(0)
    return sums.withColumns({"lost": lost, "fraction_lost": fraction.cast("int")})


def _jitter(rate: int):
    def make():
        transit, jitter = None, 0.0

        def step(arrival: int, ts: int) -> tuple:
            nonlocal transit, jitter
            now = arrival * rate / 1e9 - ts
            if transit is not None:
                jitter += (abs(now - transit) - jitter) / 16
            transit = now
            return (jitter,)

        return step

    return make


def interarrival_jitter(df: DataFrame, arrival: str = "pts", ts: str = "rtp_ts", rate: int = 90_000, partition_by=STREAM, order_by=ORDER) -> DataFrame:
    """``jitter`` after each packet, in ticks: J moves by a sixteenth of |D| - J, D being the change in transit time."""
    return annotate(df, _jitter(rate), [F.col(arrival), F.col(ts)], "jitter double", partition_by, order_by)


def sender_stats(df: DataFrame, by: str = "ssrc") -> DataFrame:
    """Packets and octets of each sender."""
    return df.groupBy(by).agg(F.count("*").alias("packets"), F.sum(F.octet_length("payload")).alias("octets"))


def report_intervals(df: DataFrame, interval: int, by: str = "stream_id", time: str = "pts") -> DataFrame:
    """Packets and octets in each report interval."""
    return df.groupBy(by, floor_div(F.col(time), interval).alias("interval")).agg(F.count("*").alias("packets"), F.sum(F.octet_length("payload")).alias("octets"))


def parse_header(df: DataFrame, packet: str = "payload") -> DataFrame:
    """The 12-byte header of each packet as struct ``rtp``; ``payload`` becomes what follows header and sources."""

    def number(start: int, n: int) -> Column:
        return F.conv(F.hex(F.substring(packet, start + 1, n)), 16, 10).cast("long")

    first, second = number(0, 1), number(1, 1)
    header = F.struct(
        number(2, 2).cast("int").alias("seq"), number(4, 4).alias("ts"), number(8, 4).alias("ssrc"), (second % 128).cast("int").alias("pt"), (second >= 128).alias("marker")
    )
    body = F.substring(F.col(packet), (13 + 4 * (first % 16)).cast("int"), F.octet_length(packet))
    good = (F.octet_length(packet) >= 12) & (F.floor(first / 64) == 2)
    return df.where(good).withColumns({"rtp": header, "payload": body})


def build_packet(df: DataFrame, payload: str = "payload") -> DataFrame:
    """``packet``: version 2, the fields of struct ``rtp``, then the payload. Numbers too long for their field wrap."""

    def raw(x: Column, digits: int) -> Column:
        return F.lpad(F.hex(x.cast("long").bitwiseAND((1 << 4 * digits) - 1)), digits, "0")

    r = F.col("rtp")
    second = r["pt"].bitwiseAND(127) + F.when(r["marker"], 128).otherwise(0)
    header = F.unhex(F.concat(F.lit("80"), raw(second, 2), raw(r["seq"], 4), raw(r["ts"], 8), raw(r["ssrc"], 8)))
    return df.withColumn("packet", F.concat(header, F.col(payload)))
