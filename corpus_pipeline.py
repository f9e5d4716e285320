"""From raw documents to packed training sequences, in five stages.

Each stage takes all documents that its predecessor kept and returns those that it keeps, with the columns of
``documents``; the last returns the pieces' places in sequences. ``run`` writes each stage's result as Parquet in
the shared folder and reads it again, so a lost executor repeats part of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowframe import runtime
from flowframe.llm.decontamination import decontaminate
from flowframe.llm.mil_quality import drop_low_quality, fitted
from flowframe.llm.packing import pack
from flowframe.llm.simhash import drop_near_duplicates
from flowframe.llm.substring_dedup import drop_repeats


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the multiple-instance classifier of ``labels.quality`` accepts."""
    return drop_low_quality(docs, fitted(spark, sf_dir, docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints (shingles of five words, eight differing bits)."""
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has."""
    return drop_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages, and without documents that are mostly such passages."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces in sequences of at most 2048 tokens."""
    return pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express a learnt classifier, suffix automata or tokenizers; tests hold each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = runtime.write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
