"""Operators on typed rows: map, filter, take, skip, fold, merge, zip, join, and the plain sources and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowframe.plans.scan import annotate, with_index

# --- sources


def from_iter(spark: SparkSession, rows: Iterable, schema: str) -> DataFrame:
    """A bounded collection of the driver as a DataFrame."""
    return spark.createDataFrame(list(rows), schema)


def range_(spark: SparkSession, start: int, end: int, name: str = "value") -> DataFrame:
    """The integers from ``start`` up to but not including ``end``."""
    return spark.range(start, end).select(F.col("id").alias(name))


def once(spark: SparkSession, **values) -> DataFrame:
    """Exactly one row."""
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))


def repeat_with(spark: SparkSession, n: int, make: Callable[[Column], Column], name: str = "value") -> DataFrame:
    """``n`` rows made from their numbers 0 to ``n - 1``; a null value is the end, as is every later row."""
    made = spark.range(n).select(F.col("id"), make(F.col("id")).alias(name))
    first_null = made.where(F.col(name).isNull()).agg(F.min("id").alias("stop"))
    # one row
    return made.join(F.broadcast(first_null)).where(F.col("id") < F.coalesce("stop", F.lit(n))).select(name)


# --- sinks


def collect(df: DataFrame, *order_by: str) -> list:
    """All rows in order, on the driver: for results that are small by construction."""
    return df.orderBy(*order_by).collect()


def discard(df: DataFrame) -> None:
    """Run ``df`` and drop what comes."""
    df.write.format("noop").mode("overwrite").save()


def for_each(df: DataFrame, f: Callable) -> None:
    """A side effect for each row, on the executors."""
    df.foreach(f)


def fold(df: DataFrame, value: Column, init: Column, step: Callable[[Column, Column], Column], order_by=("sequence",), partition_by=(), name: str = "folded") -> DataFrame:
    """Ordered left fold of a stream's values: ``step(accumulator, value)`` from ``init``.

    The values of a stream are brought together (only they, not their rows). For sums, counts, minima and
    maxima use :func:`summarise`, which combines partial results before the shuffle.
    """
    items = F.array_sort(F.collect_list(F.struct(*order_by, value.alias("_value"))))
    return df.groupBy(*partition_by).agg(F.aggregate(items, init, lambda a, x: step(a, x["_value"])).alias(name))


def fold_stream(df: DataFrame, value: Column, make: Callable, kind: str, order_by=("sequence",), partition_by=("stream_id",), name: str = "folded") -> DataFrame:
    """Ordered left fold in bounded memory, for streams too long to bring together: ``make()`` gives a function from
    a value to the accumulator after it, of the DDL type ``kind``; the last one of each stream is the result."""
    steps = annotate(df.select(*partition_by, *order_by, value.alias("_value")), lambda: _one(make()), [F.col("_value")], f"_folded {kind}", partition_by, order_by)
    return steps.groupBy(*partition_by).agg(F.max_by("_folded", F.struct(*order_by)).alias(name))


def _one(f: Callable) -> Callable:
    return lambda value: (f(value),)


def summarise(df: DataFrame, partition_by=(), **aggregates: Column) -> DataFrame:
    """Commutative folds, combined before the shuffle."""
    return df.groupBy(*partition_by).agg(*(c.alias(k) for k, c in aggregates.items()))


# --- one input


def map_(df: DataFrame, *columns: Column | str) -> DataFrame:
    return df.select(*columns)


def filter_(df: DataFrame, keep: Column | str) -> DataFrame:
    """Rows for which ``keep`` is true; null is not true."""
    return df.where(keep)


def filter_map(df: DataFrame, **columns: Column) -> DataFrame:
    """The new columns where all of them have a value: ``try_cast`` and the like give null for "none"."""
    made = df.select("*", *(c.alias(f"_new_{k}") for k, c in columns.items()))
    kept = made
    for k in columns:
        kept = kept.where(F.col(f"_new_{k}").isNotNull())
    return kept.select(*(c for c in df.columns if c not in columns), *(F.col(f"_new_{k}").alias(k) for k in columns))


def inspect(df: DataFrame, observation: Observation, **metrics: Column) -> DataFrame:
    """Pass rows on; ``observation.get`` has the metrics after an action."""
    return df.observe(observation, *(c.alias(k) for k, c in metrics.items()))


def take(df: DataFrame, n: int, *order_by: str) -> DataFrame:
    """The first ``n`` rows: a top-n, which keeps n rows from each task."""
    return df.orderBy(*order_by).limit(n)


def skip(df: DataFrame, n: int, *order_by: str) -> DataFrame:
    """All rows but the first ``n``, which are found as a top-n and taken out by their place in the order."""
    edge = df.select(*order_by).orderBy(*order_by).limit(n).agg(F.count("*").alias("_n"), F.max(F.struct(*order_by)).alias("_edge"))
    # one row; the order is unique, so rows after the n-th are those greater than it
    kept = df.join(F.broadcast(edge)).where((F.col("_n") < n) & F.lit(False) | F.coalesce(F.struct(*order_by) > F.col("_edge"), F.lit(n <= 0)))
    return kept.drop("_n", "_edge")


# --- two inputs


def merge(left: DataFrame, right: DataFrame, *order_by: str) -> DataFrame:
    """All rows of both, alternately from left and right until one ends; ``position`` says the order."""
    sides = [with_index(df, order_by, "_i").withColumn("_side", F.lit(side)) for side, df in ((0, left), (1, right))]
    counts = [df.agg(F.count("*").alias("n")) for df in (left, right)]
    both = counts[0].select(F.col("n").alias("_nl")).join(F.broadcast(counts[1].select(F.col("n").alias("_nr"))))
    shorter = F.least("_nl", "_nr")
    position = F.when(F.col("_i") < shorter, 2 * F.col("_i") + F.col("_side")).otherwise(F.col("_i") + shorter)
    all_ = sides[0].unionByName(sides[1]).join(F.broadcast(both))
    return all_.withColumn("position", position).drop("_i", "_side", "_nl", "_nr")


def zip_(left: DataFrame, right: DataFrame, left_order, right_order) -> DataFrame:
    """Pairs by place, as many as the shorter side has; ``index`` is the place."""
    a, b = with_index(left, left_order), with_index(right, right_order)
    return a.join(b, "index")


def join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Inner join on keys that are unique on either side; Spark picks the strategy."""
    return left.join(right, left[left_key] == right[right_key])


def join_pairing(left: DataFrame, right: DataFrame, key: str, left_order: str, right_order: str) -> DataFrame:
    """Inner join one to one: the k-th row of a key on the left with its k-th row on the right; others go."""
    a = left.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(left_order)))
    b = right.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(right_order)))
    return a.join(b, [key, "_k"]).withColumnRenamed("_k", "pair")
