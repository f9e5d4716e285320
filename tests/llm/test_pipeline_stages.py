"""The whole pipeline on small tables: each stage's decisions take effect and clean documents stay."""

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from flowframe.llm import decontamination as D


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    columns = docs.columns
    kept, sizes = docs, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf).cache()
        assert kept.columns == columns
        sizes.append(kept.count())
        assert kept.select("doc_id").distinct().count() == sizes[-1]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.6 * sizes[0]
    left = D.find_contamination(kept, spark.read.parquet(f"{sf}/benchmark.parquet")).where("size(items) > 0").count()
    assert left == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    n = {i: len(e.ids) + 1 for i, e in zip(texts, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode_batch(list(texts.values()), add_special_tokens=False))}
    assert {i: sum(r["length"] for r in packed if r["doc_id"] == i) for i in n} == n


def test_run_and_registration(spark, sf):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    rows = corpus_pipeline.run(spark, sf).collect()
    used = {}
    for r in rows:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= 2048 and len(used) <= sum(used.values()) / 2048 * 1.1 + 2
