"""Packing documents' token pieces into as few sequences of a fixed length as can be found.

Sizes are whole numbers up to the length of a sequence, so the instance is a histogram of at most that many
counts however large the corpus is. The plan is made from the histogram: Martello and Toth's dominance tests fix
sequences that no better packing needs to change, and best fit in decreasing order packs the rest. Pieces then
find their place by their rank among the pieces of their size, without any of them meeting on the driver.

Rows: a null text is empty (the end id alone); a null ``doc_id`` keeps null in the result; repeated rows are all
packed; pieces of one size are ranked by where they stand in the table of pieces; ids of another type than an integer
are refused; an empty table packs into nothing; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowframe import runtime
from flowframe.llm.common import require_integer, tidy

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
SEQUENCE = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SALTED = PIECES + ", salt long"
#: Rows of one size that a task ranks at once: groups larger than this are split by a hash.
RANKED = 1_000_000


def piece_rows(vocabulary: str, end_id: int, sequence: int):
    """For ``mapInArrow`` over (doc_id, text): the pieces of each document, the first being the short one.

    ``salt`` tells a piece from all others by the task and the piece's place in it.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from flowframe.llm.tokens import encoder

        enc, salt = encoder(vocabulary), TaskContext.get().partitionId() << 40
        for batch in batches:
            rows: list[tuple] = []
            offsets, ids = enc.encode(batch.column("text"), end_id)
            raw = memoryview(ids.astype("<u4").tobytes())
            for doc_id, at, n in zip(batch.column("doc_id").to_pylist(), offsets.tolist(), np.diff(offsets).tolist()):
                start = 0
                for piece in range(-(-n // sequence)):
                    length = n % sequence or sequence if piece == 0 else sequence
                    rows.append((doc_id, piece, start, length, zlib.crc32(raw[4 * (at + start) : 4 * (at + start + length)]), salt))
                    start, salt = start + length, salt + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows) if rows else [()] * 6, kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return run


def reduce_by_dominance(counts: dict[int, int], sequence: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Martello and Toth's reduction on a histogram: ((sizes, times) fixed, the counts left).

    For a largest piece j of the rest, a set holding j that dominates every other such set is fixed:
    j alone if nothing fits beside it; j and the largest piece p that fits, if the two fill the sequence or if
    no two further pieces fit; if two fit at most, {j, p} when p is at least as large as the best pair a + b that
    fits, or {j, a, b} when a is as large as p and no two pieces larger than b fit together beside j. Equal
    sets are fixed as often as the counts allow, for none of these tests turns false as pieces go.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    fixed: list[tuple[tuple[int, ...], int]] = []
    sizes = sorted(left)

    def has(size: int, *without: int) -> bool:
        return left.get(size, 0) - without.count(size) > 0

    def smallest(k: int, without: int) -> int | None:
        """The sum of the k smallest pieces besides one of ``without``."""
        total, need = 0, k
        for s in sizes:
            n = left.get(s, 0) - (s == without)
            if n > 0:
                total, need = total + s * min(n, need), need - min(n, need)
                if not need:
                    return total
        return None

    def largest(room: int, *without: int) -> int | None:
        lo, hi = 0, len(sizes)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if sizes[mid] <= room else (lo, mid)
        for at in range(lo - 1, -1, -1):
            if has(sizes[at], *without):
                return sizes[at]
        return None

    def fix(*items: int) -> None:
        times = min(left[s] // items.count(s) for s in set(items))
        for s in set(items):
            left[s] -= times * items.count(s)
        fixed.append((items, times))

    def step(j: int) -> bool:
        room = sequence - j
        p = largest(room, j)
        if p is None:
            fix(j)
            return True
        two = smallest(2, j)
        if p == room or two is None or two > room:
            fix(j, p)
            return True
        three = smallest(3, j)
        if three is not None and three <= room:
            return False
        best: tuple[int, int] | None = None
        for a in reversed(sizes):
            if a < room and has(a, j) and (b := largest(min(room - a, a), j, a)) is not None and (best is None or a + b > sum(best)):
                best = (a, b)
        if best is None or p >= sum(best):
            fix(j, p)
            return True
        a, b = best
        larger = [x for x in sizes if x > b for _ in range(min(2, left.get(x, 0) - (x == j) - (x == a)))][:2]
        if a == p and (len(larger) < 2 or sum(larger) > room):
            fix(j, a, b)
            return True
        return False

    for j in sorted(left, reverse=True):
        while left.get(j, 0) > 0 and step(j):
            pass
        sizes = [s for s in sizes if left.get(s, 0) > 0]
    return fixed, {s: n for s, n in left.items() if n > 0}


def plan(counts: dict[int, int], sequence: int) -> list[tuple[int, int, int, int, int]]:
    """Places for all pieces: (size, first rank, pieces, first sequence, offset); one piece in each sequence.

    Best fit in decreasing order takes all pieces of a size at once: open sequences with equal room are a range.
    """
    places: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = defaultdict(int)
    sequences = 0

    def put(size: int, n: int, first: int, offset: int) -> None:
        places.append((size, used[size], n, first, offset))
        used[size] += n

    fixed, left = reduce_by_dominance(counts, sequence)
    for items, times in fixed:
        offset = 0
        for size in items:
            put(size, times, sequences, offset)
            offset += size
        sequences += times
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room: ranges of sequences
    for size in sorted(left, reverse=True):
        n = left[size]
        while n:
            fit = min((r for r in room if r >= size and room[r]), default=None)
            if fit is None:
                each = sequence // size
                opened = -(-n // each)
                first, sequences = sequences, sequences + opened
                room[sequence].append((first, opened))
                fit = sequence
            first, many = room[fit].pop()
            take = min(n, many)
            put(size, take, first, sequence - fit)
            room[fit - size].append((first, take))
            if take < many:
                room[fit].append((first + take, many - take))
            if not room[fit]:
                del room[fit]
            n -= take
    return places


def place_rows(places: list[tuple[int, int, int, int, int]]):
    """For ``mapInArrow`` over pieces with their ``rank`` among pieces of their length: sequence and offset."""
    by_size: dict[int, np.ndarray] = {}
    grouped: dict[int, list] = defaultdict(list)
    for size, *rest in places:
        grouped[size].append(rest)
    for size, rows in grouped.items():
        by_size[size] = np.array(rows, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty_like(length), np.empty_like(length)
            for size in np.unique(length):
                mine, rows = length == size, by_size[int(size)]
                at = np.searchsorted(rows[:, 0], rank[mine], "right") - 1
                sequence[mine] = rows[at, 2] + rank[mine] - rows[at, 0]
                offset[mine] = rows[at, 3]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            columns = [batch.column(c) for c in names] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, sequence: int = SEQUENCE, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Pack ``docs`` (doc_id, text): one row per piece with its sequence_id and offset there.

    The pieces (about 40 bytes each, no ids) are written once to the shared folder. What reaches the driver is
    the histogram, at most ``sequence`` rows; what goes out is the plan, whose ranges are bounded by the number
    of distinct sizes and of open rooms, not by documents.
    """
    require_integer(docs)
    spark = docs.sparkSession
    runtime.ship(spark)
    runtime.small_arrow_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces, _ = runtime.write_table(rows.mapInArrow(piece_rows(vocabulary, end_id, sequence), SALTED), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # a size that many pieces share is ranked in several groups, at any size of input by the same rule
    groups = max(1, -(-max(counts.values(), default=0) // RANKED)) * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("salt"), F.lit(groups)))
    sizes = dealt.groupBy("length", "group").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("group").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select("length", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("length", "group").orderBy("salt")
    ranked = dealt.withColumn("within", F.row_number().over(within) - 1).join(bases, ["length", "group"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("within")).alias("rank"))
    return ranked.mapInArrow(place_rows(plan(counts, sequence)), PIECES + ", sequence_id long, offset long")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
