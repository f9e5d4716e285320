"""The one kernel for operators that are sequential by nature: an ordered scan that carries state along a stream.

Streams are dealt by their key and sorted; each task then runs over its streams in Arrow batches and keeps only
the current stream's state, so a stream of any length takes bounded memory. What such an operator decides about a
row (kept or not, its batch, its departure) is added as columns, and ordinary DataFrame operations do the rest.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from flowframe import runtime

#: Makes a stream's state: a function from a row's inputs to its outputs, both tuples.
Stepper = Callable[[], Callable[..., tuple]]


def annotate(df: DataFrame, make: Stepper, inputs: list[Column], outputs: str, partition_by=("stream_id",), order_by=("sequence",)) -> DataFrame:
    """``df`` with the columns ``outputs`` (DDL) that a scan of each stream in order computes from ``inputs``.

    ``order_by`` has to be unique within a stream for the result to be one only. Without ``partition_by`` all
    rows are one stream in one task: that is what a scan over everything means, so name a key where there is one.
    """
    spark = df.sparkSession
    runtime.ship(spark)
    keys, order = [F.col(c) if isinstance(c, str) else c for c in partition_by], [F.col(c) if isinstance(c, str) else c for c in order_by]
    packed = df.select(
        F.struct(*(F.col(c) for c in df.columns)).alias("row"),
        F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys))).alias("key") if keys else F.struct(F.lit(0).alias("k0")).alias("key"),
        *(o.alias(f"o{i}") for i, o in enumerate(order)),
        *(c.alias(f"i{i}") for i, c in enumerate(inputs)),
    )
    sorts = [f"o{i}" for i in range(len(order))]
    dealt = packed.repartition("key") if keys else packed.coalesce(1)
    added = T.StructType.fromDDL(outputs)
    schema = T.StructType([packed.schema["row"], *added.fields])
    scanned = dealt.sortWithinPartitions("key", *sorts).mapInArrow(_scan(make, len(inputs), added), schema)
    return scanned.select("row.*", *added.fieldNames())


def _scan(make: Stepper, n_inputs: int, added: T.StructType):
    kinds = [to_arrow_type(f.dataType) for f in added.fields]
    names = added.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, step = None, None
        for batch in batches:
            columns = [batch.column(f"i{i}").to_pylist() for i in range(n_inputs)]
            found = []
            for key, *values in zip(batch.column("key").to_pylist(), *columns):
                if step is None or key != current:
                    current, step = key, make()
                found.append(step(*values))
            out = [pa.array(x, kind) for x, kind in zip(zip(*found) if found else [()] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *out], names=["row", *names])

    return run


class Carried(Protocol):
    """A scan that can begin anywhere in a stream, since a summary of a range of rows says what they make of any state.

    Columns are Arrow arrays, one for each input, of rows of one stream in order; ``None`` is the state before a stream's
    first row and the summary of no rows. States are small; summaries are to be small beside their rows.
    """

    outputs: str

    def summarise(self, columns: list[pa.Array], summary: Any) -> Any:
        """The summary of the rows behind ``summary`` and of these."""

    def carry(self, state: Any, summary: Any) -> Any:
        """The state after the summary's rows, from that before them."""

    def run(self, columns: list[pa.Array], state: Any) -> tuple[list, Any]:
        """What the scan says of the rows, an array for each output, and the state after them."""


def annotate_spread(df: DataFrame, scan: Carried, inputs: list[Column], partition_by=("stream_id",), order_by=("sequence",)) -> DataFrame:
    """As :func:`annotate`, for streams that may hold a large share of all rows, or all: several tasks share a stream.

    Rows are dealt by ranges of (stream, order) and written as a table in the shared folder with one summary for each
    range; the summaries, taken in order one at a time, give the state before each range, and from there each range is
    scanned by a task of its own.
    """
    spark = df.sparkSession
    runtime.ship(spark)
    keys, order = [F.col(c) if isinstance(c, str) else c for c in partition_by], [F.col(c) if isinstance(c, str) else c for c in order_by]
    columns = [F.struct(*(F.col(c) for c in df.columns)).alias("row"), *(k.alias(f"k{i}") for i, k in enumerate(keys)), *(c.alias(f"i{i}") for i, c in enumerate(inputs))]
    names = [*(f"k{i}" for i in range(len(keys))), *(f"i{i}" for i in range(len(inputs)))]
    packed = df.select(*columns, *(o.alias(f"o{i}") for i, o in enumerate(order)))
    sorts = [*(f"k{i}" for i in range(len(keys))), *(f"o{i}" for i in range(len(order)))]
    ranged = packed.repartitionByRange(*sorts).sortWithinPartitions(*sorts).select("row", *names, F.spark_partition_id().alias("_part"))
    row = packed.schema["row"].dataType
    kept = T.StructType([T.StructField("row", row), T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType()), T.StructField("_summary", T.BinaryType())])
    table, _ = runtime.write_table(ranged.mapInArrow(_summaries(scan, len(keys), len(inputs)), kept), "spread")

    before, carried = {}, None
    # one row for each range partition, fetched one after the other
    for part, summary in table.where("_summary is not null").select("_part", "_summary").orderBy("_part").toLocalIterator():
        before[part] = carried
        first, last = pickle.loads(summary)
        key, found = last or first
        state = carried[1] if carried and not last and carried[0] == key else None
        carried = key, scan.carry(state, found)

    back = table.where("_summary is null").select("row.*", "_part", "_local").select(*columns, "_part", "_local")
    dealt = back.repartitionById(max(before, default=0) + 1, "_part").sortWithinPartitions("_part", "_local")
    added = T.StructType.fromDDL(scan.outputs)
    scanned = dealt.mapInArrow(_resume(scan, before, len(keys), len(inputs), added), T.StructType([T.StructField("row", row), *added.fields]))
    return scanned.select("row.*", *added.fieldNames())


def _runs(batch: pa.RecordBatch, n_keys: int, n_inputs: int) -> Iterator[tuple[tuple, list[pa.Array]]]:
    """The key and the inputs of each stream in a batch sorted by stream."""
    keys, inputs = ([batch.column(f"{c}{i}") for i in range(n)] for c, n in (("k", n_keys), ("i", n_inputs)))
    changed = np.zeros(max(batch.num_rows - 1, 0), dtype=bool)
    for k in keys:
        if pa.types.is_nested(k.type):
            values = k.to_pylist()
            changed |= np.array([a != b for a, b in zip(values, values[1:])], dtype=bool)
            continue
        differ = pc.fill_null(pc.not_equal(k[:-1], k[1:]), False)
        changed |= pc.or_(differ, pc.xor(k[:-1].is_null(), k[1:].is_null())).to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield tuple(k[a].as_py() for k in keys), [c.slice(a, b - a) for c in inputs]


def _summaries(scan: Carried, n_keys: int, n_inputs: int):
    """The rows with their places in their range, then the summaries of the range's first stream and, if another, its last."""
    names = ["row", "_part", "_local", "_summary"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, first, last = 0, None, None
        for batch in batches:
            n, kind = batch.num_rows, batch.column("row").type
            for key, columns in _runs(batch, n_keys, n_inputs):
                if last is None or key != last[0]:
                    last = [key, None]
                    first = first or last
                last[1] = scan.summarise(columns, last[1])
            part = batch.column("_part")
            yield pa.RecordBatch.from_arrays([batch.column("row"), part, pa.array(np.arange(local, local + n)), pa.nulls(n, pa.binary())], names=names)
            local += n
        if last:
            found = pickle.dumps((first, None if last is first else last))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), part[:1], pa.nulls(1, pa.int64()), pa.array([found], pa.binary())], names=names)

    return run


def _resume(scan: Carried, before: dict, n_keys: int, n_inputs: int, added: T.StructType):
    kinds = [to_arrow_type(f.dataType) for f in added.fields]
    names = ["row", *added.fieldNames()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, key, state = None, None, None
        for whole in batches:
            parts = whole.column("_part").to_numpy()
            edges = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), whole.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                batch = whole.slice(a, b - a)
                if parts[a] != at:
                    at = int(parts[a])
                    key, state = before[at] or (None, None)
                found = []
                for own, columns in _runs(batch, n_keys, n_inputs):
                    key, state = own, state if own == key else None
                    out, state = scan.run(columns, state)
                    found.append(out)
                out = [pa.concat_arrays([pa.array(x, kind) for x in column]) for column, kind in zip(zip(*found), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("row"), *out], names=names)

    return run


def with_index(df: DataFrame, order_by, name: str = "index") -> DataFrame:
    """``df`` with each row's place in the whole order, from 0, without bringing all rows to one task.

    Rows are dealt by ranges and numbered within them; the sizes of the ranges, one row each, give the offsets.
    The ranges are kept as a table in the shared folder, since a second sampling could draw other bounds.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    packed = df.repartitionByRange(*order).sortWithinPartitions(*order).select(
        F.struct(*(F.col(c) for c in df.columns)).alias("row"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("local")
    )
    table, _ = runtime.write_table(packed, "indexed")
    sizes = table.groupBy("part").agg(F.count("*").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # one row for each range partition
    return table.join(F.broadcast(bases), "part").select("row.*", (F.col("base") + F.col("local")).alias(name))


def stream_index(df: DataFrame, partition_by, order_by, name: str = "index", spread: bool = False) -> DataFrame:
    """``df`` with each row's place in its stream, from 0.

    By default a window by stream. Where one stream may hold a large share of all rows use ``spread``: the place in
    the order of (stream, order) comes from range partitions, which cut through streams, and the stream's first
    place, a minimum with partial results, is taken from it.
    """
    if not spread:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*partition_by).orderBy(*order_by)).cast("long") - 1)
    placed = with_index(df, [*partition_by, *order_by], "_place")
    first = placed.groupBy(*partition_by).agg(F.min("_place").alias("_first"))
    if not partition_by:
        return placed.withColumnRenamed("_place", name)
    keyed = first.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(partition_by)), "_first")
    joined = placed.join(keyed, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(partition_by)])
    return joined.withColumn(name, F.col("_place") - F.col("_first")).select(*df.columns, name)


#: Rows of a block: a power of two.
BLOCK_BITS = 16


def spread_before(df: DataFrame, value: str, name: str, partition_by=("stream_id",), order_by=("sequence",), highest: bool = False) -> DataFrame:
    """``df`` with the ``value`` of the row before in the stream, or with ``highest`` the greatest of all rows before.

    As a window by stream, for streams that may hold a large share of all rows, or all. Ranges of (stream, order) are
    kept as a table in the shared folder and cut into blocks of 65,536 rows; windows are by block, and what a block
    takes from those before it comes from one row for each block and stream.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in partition_by]
    ranged = df.repartitionByRange(*keys, *order_by).sortWithinPartitions(*keys, *order_by)
    # the partition's number, then the row's place in it
    table, _ = runtime.write_table(ranged.withColumn("_block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)), "blocks")
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    ends = table.groupBy("_block", *named).agg((F.max(value) if highest else F.max_by(value, F.struct(*order_by))).alias("_end"))
    inside = W.partitionBy("_block", *keys).orderBy(*order_by)
    across = W.partitionBy(*(f"_k{i}" for i in range(len(keys)))).orderBy("_block")
    carried = F.max("_end").over(across.rowsBetween(W.unboundedPreceding, -1)) if highest else F.lag("_end").over(across)
    carries = ends.withColumn("_carried", carried).where("_carried is not null").withColumnRenamed("_block", "_b").drop("_end")
    local = F.max(value).over(inside.rowsBetween(W.unboundedPreceding, -1)) if highest else F.lag(value).over(inside)
    begins = F.row_number().over(inside) == 1
    same = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        same &= k.eqNullSafe(F.col(f"_k{i}"))
    # at most one row for each block, since only its first stream goes on from another
    joined = table.withColumns({"_local": local, "_begins": begins}).join(F.broadcast(carries), same, "left")
    found = F.greatest("_local", "_carried") if highest else F.when(F.col("_begins"), F.col("_carried")).otherwise(F.col("_local"))
    return joined.select(*df.columns, found.alias(name))
