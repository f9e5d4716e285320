"""SimHash near-duplicates: documents whose 64-bit fingerprints differ in at most a few bits, and their components.

Candidates come from an embedding: the fingerprint's segments are mapped to their numbers of set bits, and the
Manhattan distance of two such vectors is a lower bound of the fingerprints' Hamming distance. Coordinates are
dealt to groups; with more groups than ``bits``, two fingerprints within ``bits`` have distance 0 in all but
``bits`` groups, so they share a cell of the grid (of width one) that is made of the coordinates of some choice of the
other groups. Within a cell the bound over all segments is tried first and the exact distance decides.

One fingerprint reaches only part of the pairs that are similar by words. Where that counts, several are made of the
same shingles: documents are linked if one of them is near, and another, the one that names a document, is not far.

Rows: texts without words, and null texts, have fingerprint 0 and are linked like any other; repeated rows and
equal texts have one fingerprint and one component; a null ``doc_id`` is in a component but never names it
(a component of such rows alone has a null name); ids of another type than an integer are refused; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowframe import runtime
from flowframe.llm.common import frugal, require_integer, texts_of, with_row
from flowframe.llm.components import connected_components

SHINGLE, BITS, SEED = 4, 4, 42
#: Bits in a segment; how likely two random ones have equal counts; comparisons that take as long as dealing a row.
SEGMENT, EQUAL, PAIRS_A_ROW = 2, 0.375, 200
#: Fingerprints of a cell that are compared at once; a cell of more is split into pairs of blocks of this size.
CELL = 4096
#: Rows of cells that a task makes where there are more than enough for all cores.
DEALT = 2_000_000
#: The bytes A to Z become a to z.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a whole text's shingles, repeats included."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)] if words else [], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    return np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")


def fingerprint(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint of shingles by their hashes; 0 without any."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hashes of the ``k``-th further fingerprint: those of the shingles, mixed; as they are for 0."""
    if not k:
        return hashes
    with np.errstate(over="ignore"):
        h = (hashes ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(29))


def fingerprint_rows(shingle: int, further: int):
    """For ``mapInArrow`` over (row, text): each row with its fingerprint as a signed long, and ``further`` others."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = []
            for text in texts_of(batch).to_pylist():
                hashes = shingle_hashes(text, shingle)
                prints.append([fingerprint(mixed(hashes, k)) for k in range(further + 1)])
            found = np.array(prints, "<u8").reshape(-1, further + 1).view("<i8")
            columns = [batch.column("row"), pa.array(found[:, 0]), pa.array(list(found[:, 1:]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "fp", "others"])

    return run


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE, further: int = 0) -> DataFrame:
    """(row, fp, others) of ``docs``: all columns but the text in ``row``."""
    runtime.ship(docs.sparkSession)
    runtime.small_arrow_batches(docs.sparkSession)
    rows = with_row(docs)
    fields = [rows.schema["row"], T.StructField("fp", T.LongType()), T.StructField("others", T.ArrayType(T.LongType()))]
    return rows.mapInArrow(fingerprint_rows(shingle, further), T.StructType(fields))


def segment_counts(fps: np.ndarray) -> np.ndarray:
    """The embedding, packed: each two bits of the result hold the number of set bits of that segment."""
    x = fps.astype(np.uint64)
    return x - ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))


LOW = 0x5555555555555555


def packed_counts(part: Column) -> Column:
    """As :func:`segment_counts`, of a column of signed longs."""
    high, low = F.shiftrightunsigned(part, 1).bitwiseAND(F.lit(LOW)), part.bitwiseAND(F.lit(LOW))
    return F.shiftleft(high.bitwiseAND(low), 1).bitwiseOR(high.bitwiseXOR(low))


def unary(counts: np.ndarray) -> np.ndarray:
    """Packed counts 0, 1, 2 as 00, 01, 11: the differing bits of two such codes are the counts' difference."""
    low = np.uint64(0x5555555555555555)
    return (counts & low) | ((counts >> np.uint64(1)) & low) | (counts & ~low)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The Manhattan distance of packed embeddings."""
    return np.bitwise_count(unary(a) ^ unary(b)).astype(np.int64)


def groups_for(n: int, bits: int = BITS) -> int:
    """How many groups to deal the segments to for ``n`` fingerprints.

    A cell joins all groups but ``bits``. More groups make smaller cells but more of them for each fingerprint; the
    number with the least expected work is taken. Any number above ``bits`` finds the same links.
    """

    def work(groups: int) -> float:
        shared = EQUAL ** (64 / SEGMENT * (groups - bits) / groups)
        return math.comb(groups, bits) * (1 + n * shared / 2 / PAIRS_A_ROW)

    return min(range(bits + 2, bits + 10), key=work)


def masks(groups: int, bits: int = BITS) -> np.ndarray:
    """For each choice of ``groups - bits`` groups, the bits of the packed embedding that lie in them."""
    segments = 64 // SEGMENT
    of_group = [sum(3 << (SEGMENT * s) for s in range(segments) if s % groups == g) for g in range(groups)]
    return np.array([sum(of_group[g] for g in choice) for choice in combinations(range(groups), groups - bits)], np.uint64)


def near(a: np.ndarray, b: np.ndarray, bits: int, far: int) -> np.ndarray:
    """Whether rows (name, part, group) of different groups are linked: parts within ``bits``, names within ``far``."""
    return (np.bitwise_count(a[..., 1] ^ b[..., 1]) <= bits) & (np.bitwise_count(a[..., 0] ^ b[..., 0]) <= far) & (a[..., 2] != b[..., 2])


def link_block(left: np.ndarray, right: np.ndarray | None, bits: int, far: int) -> np.ndarray:
    """Pairs of groups that connect what pairs of ``left`` (or of ``left`` and ``right``), as rows of :func:`near`, connect.

    All pairs are tried, some rows at a time. Where there are more links than rows, which only dense groups have, a
    spanning set of them is taken instead.
    """
    nodes = left if right is None else np.concatenate([left, right])
    codes = unary(segment_counts(nodes[:, 1]))
    begin = 0 if right is None else len(left)
    found, n = [np.empty((0, 2), np.uint64)], 0
    step = max(1, (1 << 18) // len(nodes))
    for at in range(0, len(left), step):
        i, j = np.nonzero(np.bitwise_count(codes[at : at + step, None] ^ codes[None, begin:]) <= bits)
        i, j = i + at, j + begin
        if right is None:
            i, j = i[i < j], j[i < j]
        linked = near(nodes[i], nodes[j], bits, far)
        found.append(np.stack([nodes[i[linked], 2], nodes[j[linked], 2]], 1))
        n += len(found[-1])
        if n > len(nodes):
            return spanning_links(nodes, codes, begin, right is not None, bits, far)
    return np.concatenate(found)


def spanning_links(nodes: np.ndarray, codes: np.ndarray, begin: int, two: bool, bits: int, far: int) -> np.ndarray:
    """As :func:`link_block`, by a search from each group in turn that looks only at those not reached yet: what is
    connected gives one pair for each group, with the group that the search began from, and nothing goes unconnected."""
    side = np.zeros(len(nodes), bool)
    side[begin:] = two
    groups, group = np.unique(nodes[:, 2], return_inverse=True)
    rows_of = np.split(np.argsort(group, kind="stable"), np.cumsum(np.bincount(group))[:-1])
    open_ = np.ones(len(nodes), bool)
    pairs: list[tuple[int, int]] = []
    for first in range(len(groups)):
        if not open_[rows_of[first][0]]:
            continue
        todo = rows_of[first].tolist()
        open_[todo] = False
        while todo:
            at = todo.pop()
            rest = np.flatnonzero(open_ & (side != side[at])) if two else np.flatnonzero(open_)
            rest = rest[np.bitwise_count(codes[rest] ^ codes[at]) <= bits]
            for g in np.unique(group[rest[near(nodes[rest], nodes[at], bits, far)]]).tolist():
                pairs.append((first, g))
                open_[rows_of[g]] = False
                todo += rows_of[g].tolist()
    return groups[np.array(pairs, np.int64).reshape(-1, 2)]


def forest(pairs: np.ndarray) -> np.ndarray:
    """Of pairs of groups, as many as connect the same: each group with the least one that is connected to it."""
    if not len(pairs):
        return pairs
    groups, ends = np.unique(pairs, return_inverse=True)
    up = list(range(len(groups)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for x, y in np.unique(ends.reshape(-1, 2), axis=0).tolist():
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    tops = np.array([top(x) for x in range(len(groups))])
    below = np.flatnonzero(tops != np.arange(len(groups)))
    return np.stack([groups[below], groups[tops[below]]], 1)


def link_rows(bits: int, far: int):
    """For ``mapInArrow`` over (cell, place, name, part, group) sorted by (cell, place): pairs (a, b) of groups.

    ``place`` is twice the number of a pair of blocks in the cell, and 1 more on the pair's second side.
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def emit(rows: list[np.ndarray]) -> pa.RecordBatch:
            cell, place = rows[:2]
            nodes = np.stack(rows[2:], 1).view(np.uint64)
            pair, side = place >> 1, place & 1
            new = np.concatenate([[True], (cell[1:] != cell[:-1]) | (pair[1:] != pair[:-1])])
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(cell))
            found = [np.empty((0, 2), np.uint64)]
            size = ends - starts
            two = np.add.reduceat(side, starts) > 0
            small = (size <= 32) & ~two
            counts = segment_counts(nodes[:, 1])
            for k in range(1, 32):
                first = np.flatnonzero((size > k) & small)
                if not len(first):
                    break
                # the rows of these groups that have one of the group k rows on
                n = size[first] - k
                at = np.repeat(starts[first] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                at = at[manhattan(counts[at], counts[at + k]) <= bits]
                at = at[near(nodes[at], nodes[at + k], bits, far)]
                found.append(np.stack([nodes[at, 2], nodes[at + k, 2]], 1))
            for g in np.flatnonzero(~small & (size > 1)):
                a, b = starts[g], ends[g]
                left = nodes[a:b] if not two[g] else nodes[a:b][side[a:b] == 0]
                right = None if not two[g] else nodes[a:b][side[a:b] == 1]
                if len(left):
                    found.append(link_block(left, right, bits, far))
            every = forest(np.concatenate(found))
            return pa.RecordBatch.from_arrays([pa.array(every[:, 0].copy().view(np.int64)), pa.array(every[:, 1].copy().view(np.int64))], names=["a", "b"])

        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in ("cell", "place", "name", "part", "group")]
            if not len(rows[0]):
                continue
            if kept:
                rows = [np.concatenate([x, y]) for x, y in zip(kept, rows)]
            last = (rows[0] == rows[0][-1]) & (rows[1] >> 1 == rows[1][-1] >> 1)
            at = int(np.argmax(last))
            kept = [x[at:] for x in rows]
            if at:
                yield emit([x[:at] for x in rows])
        if kept:
            yield emit(kept)

    return run


def fingerprint_links(nodes: DataFrame, groups: int, bits: int = BITS, far: int = 64, rows: int = 0) -> DataFrame:
    """Pairs (a, b) of groups that connect what all pairs of ``nodes`` connect: (name, part, k, group).

    Two rows with equal ``k`` are linked if their parts differ in at most ``bits`` bits and their names in at most
    ``far``; rows of one ``group`` are connected already. A row goes to a cell for each choice of groups of coordinates;
    cells and their numbers are expressions, and what is dealt is (choice, name, part, group, place). Cells of more than
    ``CELL`` rows are split: each row goes to the pairs of blocks that its block is in, so no task holds more than two
    blocks of a cell, whatever the cell's size. ``rows``: about how many nodes there are; a small table becomes many
    rows here, which are made by as many tasks as they ask for.
    """
    spark = nodes.sparkSession
    runtime.ship(spark)
    chosen = [int(x) for x in masks(groups, bits).view(np.int64)]
    nodes = nodes.repartition(max(spark.sparkContext.defaultParallelism, -(-rows * len(chosen) // DEALT)), "name", "part")
    codes = F.explode(F.sequence(F.lit(0), F.lit(len(chosen) - 1)))
    carried = ("name", "part", "group")
    coded = nodes.select(*carried, "k", codes.alias("c")).select(*carried, (F.col("k") * len(chosen) + F.col("c")).alias("code"))
    # a clash of the hash only adds candidates
    mask = F.element_at(F.lit(chosen), F.col("code") % len(chosen) + 1)
    cell = F.xxhash64(packed_counts(F.col("part")).bitwiseAND(mask), "code")
    sizes = coded.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))
    hot, _ = runtime.write_table(sizes.where(F.col("n") > CELL), "hot-cells")
    # cells that hold more than CELL rows are few: at most their number times the choices / CELL
    joined = coded.withColumn("cell", cell).join(hot, "cell", "left")
    blocks = F.coalesce(F.ceil(F.col("n") / CELL), F.lit(1)).cast("long")
    dealt = joined.select("code", *carried, blocks.alias("blocks"), F.pmod(F.xxhash64("name", "part"), blocks).alias("block"))
    pairs = dealt.select("code", *carried, "blocks", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    number = F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")
    spread = pairs.select("code", *carried, (2 * number + (F.col("block") > F.col("other")).cast("long")).alias("place"))
    together = spread.repartition(cell, F.shiftright("place", 1))
    return together.select(cell.alias("cell"), "place", *carried).sortWithinPartitions("cell", "place").mapInArrow(link_rows(bits, far), "a long, b long")


def near_duplicate_components(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, further: int = 0, far: int = 64) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, fp) of all ``docs``, which need ``doc_id`` and ``text``, and (fp, component_id, root) of every
    fingerprint; ``digest`` is a hash of the text.

    Links are those of :func:`fingerprint_links`: of the fingerprints themselves, or, with ``further`` ones, of each
    of those, while the fingerprint names the document. The first of the further ones comes first, and the others are
    searched for links between its components only: in a dense group nearly all are within one by then.

    Equal fingerprints are put together first, by aggregation with partial sums, so copies never meet in a task
    and are never expanded into pairs. Both tables lie in the shared folder; neither has texts.
    """
    require_integer(docs)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(docs["text"]).alias("digest"), "text")
    prints, _ = runtime.write_table(with_fingerprints(keyed, shingle, further).select("row.doc_id", "row.digest", "fp", "others"), "fingerprints")
    distinct, _ = runtime.write_table(prints.groupBy("fp", "others").agg(F.min("doc_id").alias("first")), "distinct")
    n = distinct.count()
    groups = groups_for(n, bits)
    one = F.element_at("others", 1) if further else F.col("fp")
    nodes = distinct.select(F.col("fp").alias("name"), one.alias("part"), F.lit(0).alias("k"), F.col("fp").alias("group"))
    roots = connected_components(fingerprint_links(nodes, groups, bits, far, n))
    root = F.coalesce("root", "fp").alias("root")
    if further > 1:
        within, _ = runtime.write_table(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "others", "first", root), "within")
        nodes = within.select(F.col("fp").alias("name"), F.posexplode("others").alias("k", "part"), F.col("root").alias("group")).where("k > 0")
        tops = connected_components(fingerprint_links(nodes, groups, bits, far, n * (further - 1)))
        tops = tops.select(F.col("node").alias("root"), F.col("root").alias("top"))
        found = within.join(tops, "root", "left").select("fp", "first", F.coalesce("top", "root").alias("root"))
    else:
        found = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", root)
    rooted, _ = runtime.write_table(found.groupBy("fp", "root").agg(F.min("first").alias("first")), "rooted")
    # a table of its own: the join with a root that very many fingerprints have is then one whose partitions can be split
    names, _ = runtime.write_table(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "names")
    return prints.select("doc_id", "digest", "fp"), rooted.join(names, "root").select("fp", "component_id", "root")


def text_digest(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and its component's smallest doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    prints, components = near_duplicate_components(docs)
    prints, components = prints.drop("digest"), components.drop("root")
    return prints.join(components, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Where documents are dropped: shingles of five words, as many differing bits as can be searched exactly at scale,
#: six fingerprints searched, and a seventh that names documents. Two texts with a Jaccard similarity of 0.8 differ in
#: 9.7 of 64 bits on average, so one fingerprint brings a third of such pairs within eight bits, and six more than nine
#: tenths. Unlike texts differ in 32 bits on average: with ``DROP_FAR`` in the seventh as well, a pair
#: of them is linked by chance with a probability of about 5e-13.
DROP_SHINGLE, DROP_BITS, DROP_FURTHER, DROP_FAR = 5, 8, 6, 18


def drop_near_duplicates(docs: DataFrame, shingle: int = DROP_SHINGLE, bits: int = DROP_BITS, further: int = DROP_FURTHER, far: int = DROP_FAR) -> DataFrame:
    """One row of each component stays, with all its columns: that with the smallest ``doc_id``.

    Rows with a null ``doc_id`` come after all others. Of rows that repeat a ``doc_id`` with different texts, each is
    judged by its own text; in one component the one of the least fingerprint, then of the least hash of the text, stays.
    Of rows equal in both, that with the least hash of its other columns stays.
    """
    prints, components = near_duplicate_components(docs.select("doc_id", "text"), shingle, bits, further, far)
    key = ["missing", "id", "digest"]
    keyed = prints.select("fp", F.isnull("doc_id").alias("missing"), F.coalesce("doc_id", F.lit(0)).alias("id"), "digest")
    counted = keyed.groupBy("fp", *key).agg(F.count("*").alias("n"))
    best = counted.groupBy("fp").agg(F.min(F.struct("missing", "id", "fp", "digest", "n")).alias("best"))
    known, _ = runtime.write_table(best.join(components, "fp").groupBy("root").agg(F.min("best").alias("best")).select("best.*").drop("fp"), "keepers")
    rows = with_row(docs, text_back=True)
    doc_id, text = F.col("row.doc_id").cast("long"), F.col("row.text")
    rows = rows.select("row", F.isnull(doc_id).alias("missing"), F.coalesce(doc_id, F.lit(0)).alias("id"), text_digest(text).alias("digest"))
    one = rows.join(known.where("n = 1").select(*key), key, "left_semi").select("row")
    # rows that are there more than once, which tables of documents have few of; one of each by partial minima
    hashed = [F.col("row")[c] for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    repeated, _ = runtime.write_table(known.where("n > 1").select(*key), "repeated")
    more = rows.join(repeated, key, "left_semi").groupBy(*key).agg(F.min_by("row", F.xxhash64(*hashed)).alias("row")).select("row")
    return one.unionByName(more).select("row.*")
