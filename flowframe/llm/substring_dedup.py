"""Substring deduplication by content-defined chunking with a gear rolling hash.

Chunks may begin at places: word starts and, in long stretches without white space (Chinese, Japanese, Thai...), any
character of three bytes or more. One begins where the gear hash of the 16 bytes before is the least among the
``REACH`` places on either side, so the cuts depend on nearby content only, an insertion shifts no chunk but those
around it, and no chunk but in periodic text is much longer than another. What is deduplicated, by digest, are windows:
from each chunk on (and up to the last), the fewest chunks in a row that have ``MIN_WORDS`` words or more. The first document (by
``doc_id``) that holds a window keeps it, at its first place there; elsewhere its chunks are cut out. So whatever goes
stands, with neighbours to that number of words, in one piece in one earlier document or earlier in its own.

Rows: null and empty texts have no chunks and stay as they are; rows with one ``doc_id`` are one document, which
never takes from itself what another of its rows has; rows with a null ``doc_id`` come after all others, equal
texts among them as one document; ids of another type than an integer are refused; texts of any length are read whole;
a stretch of ASCII without white space is one word however long it is; an empty table gives no rows; further columns
pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowframe import runtime
from flowframe.llm.common import frugal, replace_text, require_integer, texts_of, with_row

#: Places on either side among which a chunk's beginning has the least hash: chunks have 7 words on average.
REACH = 3
#: Stretches of fewer words stay. A passage loses a few words at either end to chunks that reach over its edges,
#: so this is well below the 50 words from which passages count, and above licence lines and other formulas.
MIN_WORDS = 16
#: Bytes without white space from which characters of three bytes or more count, two of them as a word.
RUN = 64
#: Bytes hashed at once, and the bytes before a place that its hash is made of.
BLOCK, REACHED = 1 << 20, 16
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
LAST = (1 << 63) - 1


def places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks may begin, and the half words from there to the next place."""
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    starts = np.flatnonzero(begins)
    after = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    ends = after if len(after) == len(starts) else np.append(after, len(data))
    wide = np.zeros(len(data), bool)
    for a, b in zip(starts[ends - starts >= RUN], ends[ends - starts >= RUN]):
        wide[a:b] = data[a:b] >= 0xE0
    at = np.flatnonzero(begins | wide)
    return at, np.where(wide[at], 1, 2)


def gear_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The gear hash of the bytes before each place."""
    out, done = np.zeros(len(at), np.uint32), 0
    for begin in range(0, len(data), BLOCK):
        low = max(0, begin - REACHED)
        h = GEAR[data[low : begin + BLOCK]]
        for k in (1, 2, 4, 8):  # after each step the hash of 2 * k bytes
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
        upto = int(np.searchsorted(at, begin + BLOCK, "right"))
        mine = at[done:upto]
        out[done:upto] = np.where(mine > 0, h[np.maximum(mine - 1 - low, 0)], 0)
        done = upto
    return out


def chunks(raw: bytes, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """Where the chunks of a text begin, in bytes, and their half words; none for an empty text."""
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, halves = places(data)
    h = gear_hashes(data, at)
    cut = at > 0
    for k in range(1, reach + 1):
        cut[k:] &= h[k:] < h[:-k]
        cut[:-k] &= h[:-k] <= h[k:]
    first = np.flatnonzero(cut)
    before = np.concatenate([[0], np.cumsum(halves)])
    return np.concatenate([[0], at[first]]), np.diff(np.concatenate([[0], before[first], before[-1:]]))


def chunk_digests(raw: bytes, starts: np.ndarray) -> list[int]:
    """Each chunk's 64-bit digest, as a signed number."""
    import xxhash

    digest, at = xxhash.xxh3_64_intdigest, starts.tolist()
    return np.array([digest(raw[a:b]) for a, b in zip(at, [*at[1:], len(raw)])], np.uint64).view(np.int64).tolist()


#: Odd, so that it has an inverse modulo 2 ** 64.
BASE = 0xD6E8FEB86659FD93


def windows(raw: bytes, starts: np.ndarray, halves: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, first chunk, chunk after) of the windows of a text: from each chunk on, and up to the last, as few as have ``min_words`` words."""
    if not len(starts):
        return (np.empty(0, np.int64),) * 3
    n = len(starts)
    sums = np.concatenate([[0], np.cumsum(halves)])
    after = np.searchsorted(sums, sums[:-1] + 2 * min_words)
    a = np.flatnonzero(after <= n)
    b = after[a]
    if len(a) and b[-1] < n:  # up to the text's end, so that nothing of a whole copy stays
        a, b = np.append(a, np.searchsorted(sums, sums[-1] - 2 * min_words, "right") - 1), np.append(b, n)
    powers, inverses = (np.cumprod(np.array([1, *[x] * (n - 1)], np.uint64)) for x in (BASE, pow(BASE, -1, 1 << 64)))
    mixed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.array(chunk_digests(raw, starts), np.int64).view(np.uint64) * powers)])
    return ((mixed[b] - mixed[a]) * inverses[a]).view(np.int64), a, b


def window_rows(min_words: int):
    """For ``mapInArrow`` over (doc, text): each different window of a text by its digest, with its document."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, digests = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                raw = text.encode("utf-8", "surrogatepass") if text else b""
                digests.append(np.unique(windows(raw, *chunks(raw), min_words)[0]))
                docs.append(np.full(len(digests[-1]), doc, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(digests)), pa.array(np.concatenate(docs))], names=["digest", "doc"])

    return run


def cut_rows(min_words: int):
    """For ``mapInArrow`` over (row, windows): the text without its repeated stretches, and their places.

    ``windows`` are the digests of the text's windows that an earlier document has.
    """
    spans_kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean, removed, spans = [], [], []
            for text, known in zip(texts_of(batch).to_pylist(), batch.column("windows").to_pylist()):
                found = repeated_spans(text, known, min_words)
                if found:
                    raw = text.encode("utf-8", "surrogatepass")
                    pieces = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *(b for _, b, _ in found)], [*(a for a, _, _ in found), len(raw)])]
                    cut = [raw[a:b].decode("utf-8", "surrogatepass") for a, b, _ in found]
                    at, places = 0, []
                    for piece, gone in zip(pieces, cut):
                        places.append({"start": at + len(piece), "end": at + len(piece) + len(gone)})
                        at += len(piece) + len(gone)
                    clean.append("".join(pieces))
                    removed.append(sum(n for _, _, n in found))
                    spans.append(places)
                else:
                    clean.append(text)
                    removed.append(0)
                    spans.append([])
            columns = [batch.column("row"), pa.array(clean, pa.string()), pa.array(removed, pa.int64()), pa.array(spans, spans_kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "clean", "n_removed_words", "spans"])

    return run


def repeated_spans(text: str | None, known: list[int] | None, min_words: int) -> list[tuple[int, int, int]]:
    """(first byte, byte after, words) of stretches of windows that an earlier document has (their digests are in
    ``known``) or that the text itself has before."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    starts, halves = chunks(raw)
    ends = np.append(starts[1:], len(raw))
    digests, a, b = windows(raw, starts, halves, min_words)
    again = np.ones(len(digests), bool)
    again[np.unique(digests, return_index=True)[1]] = False
    again |= np.isin(digests, np.array(known or (), np.int64))
    depth = np.zeros(len(starts) + 1, np.int64)
    np.add.at(depth, a[again], 1)
    np.add.at(depth, b[again], -1)
    edges = np.diff(np.concatenate([[0], np.cumsum(depth) > 0]).astype(np.int8))
    found = []
    for x, y in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)):
        first, last = int(starts[x]), int(ends[y - 1])
        found.append((first, last, len(raw[first:last].split())))
    return found


def document(doc_id: Column, text: Column) -> Column:
    """What a row is known by: its ``doc_id``, or without one a number after all others from its text."""
    own = F.lit(LAST) - F.pmod(F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))), F.lit(1 << 40))
    return F.coalesce(doc_id.cast("long"), own)


def find_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``row`` (all columns of ``docs``), ``clean`` text, ``n_removed_words`` and ``spans`` (start, end in characters).

    First documents are minima by digest with partial sums, so a window that a third of the corpus shares is one row
    from each task there. Only digests of two documents or more are joined back; large partitions of that join
    are split at run time. Digests are computed twice rather than kept on disk; stretches within one document
    need no shuffle.
    """
    require_integer(docs)
    spark = docs.sparkSession
    runtime.ship(spark)
    runtime.small_arrow_batches(spark)
    rows = docs.select(document(docs["doc_id"], docs["text"]).alias("doc"), docs["text"].cast("string").alias("text"))
    every = rows.mapInArrow(window_rows(min_words), "digest long, doc long")
    firsts = every.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("final"))
    later = every.join(firsts.where("first < final").select("digest", "first"), "digest").where("doc > first")
    per_doc = later.groupBy("doc").agg(F.collect_set("digest").alias("windows"))
    keyed = with_row(docs, text_back=True).select("row", document(F.col("row.doc_id"), F.col("row.text")).alias("doc"))
    joined = keyed.join(per_doc, "doc", "left").select("row", "windows")
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([keyed.schema["row"], T.StructField("clean", T.StringType()), T.StructField("n_removed_words", T.LongType()), T.StructField("spans", spans)])
    return joined.mapInArrow(cut_rows(min_words), schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated passages: doc_id, text, n_removed_words, spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_repeats(docs)
    return found.select("row.doc_id", F.col("clean").alias("text"), "n_removed_words", "spans")


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated passages cut; documents that this leaves without a word go. Columns stay."""
    found = find_repeats(docs, min_words).where((F.col("n_removed_words") == 0) | F.col("clean").rlike(r"[^\x20\x09-\x0D]"))
    return replace_text(found, docs.columns, "clean")
