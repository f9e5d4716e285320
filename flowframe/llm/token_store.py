"""Token-ID output: ORC files of token ids in ascending document order, read by stripe.

Layout: one file per task, one row per document, ``doc_id``, ``shard`` (the writing task), ``local_start`` (ids
of the shard's documents before this one), ``n_tokens`` and ``ids``. ORC writes ids with integer run-length
encoding; row indexes and Bloom filters on ``doc_id`` let a reader skip stripes and row groups by metadata.

Rows: a null text is empty (only the end id); a null ``doc_id`` sorts first; rows that repeat a ``doc_id`` are
all kept, in the order of a hash of their text; ids of another type than an integer are refused; an empty table gives
no rows; further columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowframe import runtime
from flowframe.llm.common import require_integer, tidy

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
STORED = "doc_id long, shard int, local_start long, n_tokens long, ids array<int>"


def encode_rows(vocabulary: str, end_id: int):
    """For ``mapInArrow`` over (doc_id, text) in order: rows as stored, with running starts within the task."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from flowframe.llm.tokens import encoder

        shard, before = TaskContext.get().partitionId(), 0
        enc = encoder(vocabulary)
        for batch in batches:
            ends, ids = enc.encode(batch.column("text"), end_id)
            n = np.diff(ends)
            ends = ends[1:]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.view(np.int32)))
            columns = [
                batch.column("doc_id").cast(pa.int64()),
                pa.array(np.full(len(n), shard, np.int32)),
                pa.array(before + ends - n),
                pa.array(n),
                lists,
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "shard", "local_start", "n_tokens", "ids"])
            before += int(ends[-1]) if len(ends) else 0

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str = VOCABULARY,
    end_id: int = END_ID,
    stripe_bytes: int = 64 << 20,
    row_index_stride: int = 1000,
) -> None:
    """Encode ``docs`` (doc_id, text) and write them as ORC under ``path`` in ascending ``doc_id`` order.

    The texts are dealt by ranges of ``doc_id`` (and of a hash of the text, so that rows without an id, or with the
    same one, go to several tasks) and sorted within tasks before they are encoded, so that ids are never shuffled
    and shards follow each other in document order.
    """
    require_integer(docs)
    spark = docs.sparkSession
    runtime.ship(spark)
    runtime.small_arrow_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    (
        ordered.mapInArrow(encode_rows(vocabulary, end_id), STORED)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.row.index.stride", str(row_index_stride))
        .option("compression", "zstd")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """The stored rows with ``start``, the ids of all documents before each.

    A condition on ``doc_id`` in ``where`` is pushed to the ORC reader, which skips stripes and row groups by
    their statistics and Bloom filters. The offsets of shards are running sums of one number per shard, which
    are as many as the tasks that wrote; they are read from the ``n_tokens`` column alone.
    """
    stored = spark.read.schema(STORED).orc(path)
    sizes = stored.groupBy("shard").agg(F.sum("n_tokens").alias("shard_tokens"))
    order = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select("shard", F.coalesce(F.sum("shard_tokens").over(order), F.lit(0)).alias("base"))
    rows = stored if where is None else stored.where(where)
    # one row per writing task: a fixed 12 bytes each, a few megabytes for a hundred thousand tasks
    joined = rows.join(F.broadcast(bases), "shard")
    return joined.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


@tidy
def digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow`` over (doc_id, start, n_tokens, ids): the CRC-32 of each row's ids."""
    for batch in batches:
        ids = batch.column("ids")
        values = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
        offsets = ids.offsets.to_numpy()
        crcs = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        columns = [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crcs, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written as ORC and read back: doc_id, start, n_tokens, ids_crc32."""
    path = runtime.new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path)
    return read_tokens(spark, path).mapInArrow(digest_rows, "doc_id long, start long, n_tokens long, ids_crc32 long")
