"""Token counts from flat token files: unsigned 16-bit little-endian ids, an end id after each document, no index.

Vocabulary ids are stored shifted by ``ID_SHIFT`` so that 0 (padding) and ``END_ID`` never stand for a token.
Files are read as they are; each is cut into blocks of a fixed number of ids with no regard for documents, and a
task reads its blocks by byte range, so a file of any size is read by many tasks and none holds more than a block.
Every block is searched for end ids at once, and a prefix scan over the blocks' summaries stitches documents
that reach over block and file boundaries.

Rows: a null text is an empty document (an end id alone); an empty table or empty files give no rows; ids after
the last end id of the last file are one further, unended document if there are any; repeated texts each count; a
document may be longer than a block or a file; the last byte of a file of odd length is left out; columns besides
``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowframe import runtime
from flowframe.llm.common import tidy

VOCABULARY = "word_bpe_49k.json"
ID_SHIFT, END_ID = 2, 1
#: Ids in a block (2 MB of file), and bytes that a task reads where there are more than the cores read at once.
BLOCK_IDS, TASK_BYTES = 1 << 20, 64 << 20


def flat_rows(vocabulary: str, shift: int):
    """For ``mapInArrow`` over (text): the bytes of each document's shifted ids, without the end id."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from flowframe.llm.tokens import encoder

        enc = encoder(vocabulary)
        for batch in batches:
            ends, ids = enc.encode(batch.column("text"))
            if len(ids) and int(ids.max()) + shift > 0xFFFF:
                raise ValueError("this vocabulary has ids of more than 16 bits")
            data, offsets = pa.py_buffer((ids + shift).astype("<u2")), pa.py_buffer((2 * ends).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(batch), [None, offsets, data])], names=["ids"])

    return run


def write_flat(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, docs_per_file: int = 20_000) -> None:
    """Encode ``docs`` (text) and write flat token files under ``path``, one or more per task.

    Spark's own text writer commits the files: a document's ids go through it as they are, and the line
    separator is the end id's two bytes.
    """
    spark = docs.sparkSession
    runtime.ship(spark)
    runtime.small_arrow_batches(spark)
    ids = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(flat_rows(vocabulary, ID_SHIFT), "ids binary")
    separator = END_ID.to_bytes(2, "little").decode("ascii")
    raw = ids.select(F.col("ids").cast("string").alias("value"))
    raw.write.option("lineSep", separator).option("maxRecordsPerFile", str(docs_per_file)).text(path)


def summary(path: str, block: int, ids: np.ndarray, end_id: int) -> pa.RecordBatch:
    """A block's length and the places of its end ids."""
    ends = np.flatnonzero(ids == end_id).astype(np.int32)
    columns = [pa.array([path]), pa.array([block], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([ends], pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, names=["path", "block", "n_ids", "ends"])


SUMMARY = "path string, block long, n_ids long, ends array<int>"


def open_file(path: str) -> pa.NativeFile:
    """A file of the listing, for reads by range."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[len("file:") :].lstrip("/"))
    store, place = fs.FileSystem.from_uri(path)
    return store.open_input_file(place)


def scan_ranges(block_ids: int, end_id: int):
    """For ``mapInArrow`` over (path, block): reads each block by its range and summarises it."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist()):
                with open_file(path) as file:
                    raw = file.read_at(2 * block_ids, 2 * block_ids * block)
                yield summary(path, block, np.frombuffer(raw, "<u2", len(raw) // 2), end_id)

    return run


def scan_files(block_ids: int, end_id: int):
    """For ``mapInArrow`` over (path, content): summarises each block of whole files."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                raw = content.as_buffer()
                ids = np.frombuffer(raw, "<u2", len(raw) // 2)
                for block, at in enumerate(range(0, len(ids), block_ids)):
                    yield summary(path, block, ids[at : at + block_ids], end_id)

    return run


def summaries(spark: SparkSession, path: str, block_ids: int, end_id: int) -> DataFrame:
    """The summaries of all blocks under ``path``.

    The listing (names and lengths; contents are not read for it) becomes a row for each block, dealt to as many tasks
    as the bytes ask for. Where a store is one that only Spark reads, whole files go through Spark instead, one a task.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 1")
    total = files.agg(F.sum("length").alias("bytes"), F.min("path").alias("one")).first()
    if total["bytes"]:
        try:
            open_file(total["one"]).close()
        except (OSError, ValueError):
            return files.select("path", "content").mapInArrow(scan_files(block_ids, end_id), SUMMARY)
    size = 2 * block_ids
    n = -(-(total["bytes"] or 0) // size)
    tasks = max(1, min(n, max(spark.sparkContext.defaultParallelism, (total["bytes"] or 0) // TASK_BYTES)))
    blocks = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 2) / size))).alias("block"))
    return blocks.repartition(tasks, "path", "block").mapInArrow(scan_ranges(block_ids, end_id), SUMMARY)


def count_tokens(spark: SparkSession, path: str, block_ids: int = BLOCK_IDS, end_id: int = END_ID) -> DataFrame:
    """One row per document of the flat files under ``path``, which are taken in the order of their paths.

    doc_no: the document's place in all files, from 0; start: ids of documents before it, end ids left out;
    n_tokens: its ids without the end id; ended: whether an end id follows.

    A document begins after the last end id before it. So the scan carries, to each block, the ids before it (a
    running sum), the end ids before it (a running sum) and the place after the last of these (a running
    maximum); first over the blocks within a file, then over files, which have one small row each.
    """
    runtime.ship(spark)
    blocks, _ = runtime.write_table(summaries(spark, path, block_ids, end_id), "token-blocks")
    in_file = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sized = blocks.select(
        "path",
        "block",
        "n_ids",
        "ends",
        F.size("ends").cast("long").alias("n_ends"),
        F.coalesce(F.sum("n_ids").over(in_file), F.lit(0)).alias("ids_before"),
    ).withColumn("after_end", F.when(F.col("n_ends") > 0, F.col("ids_before") + F.element_at("ends", -1) + 1))
    within = sized.select(
        "*",
        F.coalesce(F.sum("n_ends").over(in_file), F.lit(0)).alias("ends_before"),
        F.max("after_end").over(in_file).alias("begin_in_file"),
    )
    per_file = sized.groupBy("path").agg(F.sum("n_ids").alias("ids"), F.sum("n_ends").alias("ends"), F.max("after_end").alias("after_end"))
    before = W.orderBy("path").rowsBetween(W.unboundedPreceding, -1)
    based = per_file.select("*", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    scanned = based.select(
        F.col("path").alias("file"),
        "base",
        F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("file_no"),
        F.coalesce(F.max(F.col("base") + F.col("after_end")).over(before), F.lit(0)).alias("entering"),
    )
    placed = within.join(scanned, F.col("path") == F.col("file")).select(
        (F.col("base") + F.col("ids_before")).alias("at"),
        (F.col("file_no") + F.col("ends_before")).alias("first_no"),
        F.coalesce(F.col("base") + F.col("begin_in_file"), F.col("entering")).alias("begin"),
        "ends",
    )
    each = placed.select("at", "first_no", "begin", "ends", F.posexplode("ends").alias("k", "end")).select(
        (F.col("first_no") + F.col("k")).alias("doc_no"),
        F.when(F.col("k") == 0, F.col("begin")).otherwise(F.col("at") + F.element_at("ends", F.greatest(F.col("k"), F.lit(1))) + 1).alias("begin"),
        (F.col("at") + F.col("end")).alias("end"),
    )
    ended = each.select("doc_no", (F.col("begin") - F.col("doc_no")).alias("start"), (F.col("end") - F.col("begin")).alias("n_tokens"), F.lit(True).alias("ended"))
    last = (
        based.agg(F.sum("ends").alias("doc_no"), F.sum("ids").alias("ids"), F.coalesce(F.max(F.col("base") + F.col("after_end")), F.lit(0)).alias("begin"))
        .where("ids > begin")
        .select("doc_no", (F.col("begin") - F.col("doc_no")).alias("start"), (F.col("ids") - F.col("begin")).alias("n_tokens"), F.lit(False).alias("ended"))
    )
    return ended.unionByName(last)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to flat token files, then counted from them alone."""
    path = runtime.new_path(spark, "flat-tokens")
    write_flat(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text"), path)
    return count_tokens(spark, path)
