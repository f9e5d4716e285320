"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowframe import runtime


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: longs, neither null) to (node, root): the smallest node of each node's component.

    Large-star links each node's larger neighbours to the smallest node of its neighbourhood, small-star its
    smaller neighbours; both keep components, and when neither changes the edges every tree is a star on its
    smallest node. A star's centre can have very many neighbours, so minima are taken by aggregation with
    partial sums and joined back. Each round is a table in the shared folder: a lost executor costs at most a
    round, and only the number of edges and a checksum reach the driver.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now, path = runtime.write_table(pairs, "edges")

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        return row[0], row[1]

    before = mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        centre = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(centre, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        after_df, after_path = runtime.write_table(small.where("u <> v").distinct(), "edges")
        after = mark(after_df)
        runtime.drop_path(spark, path)
        now, path = after_df, after_path
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
