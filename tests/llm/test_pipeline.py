"""The pipeline, each stage recomputed from what its predecessor kept."""

import collections

import numpy as np

import corpus_pipeline
from kinfabric.llm import mixing, quality, tokens
from kinfabric.llm.shared import materialize
from tests.llm.test_odd_input import grams, linked, lower
from tests.llm.test_packing_exact import slow_least

D = "/root/testdata/sf0.001"


def test_each_stage(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").withColumn("_rk", quality.F.lit("clash"))
    labels = spark.read.parquet(f"{D}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact", "near", "mix", "pack"]
    kept = materialize(stages["quality"](spark, docs, D), "test-quality")
    verdicts = {(r.doc_id, r.rk): r.keep for r in quality.score(docs, labels).collect()}
    keyed = docs.withColumn("rk_", quality._row(docs)).collect()
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted((r.doc_id, r.text) for r in keyed if verdicts[r.doc_id, r.rk_])
    bad = {r.doc_id for r in labels.collect() if r.quality == 0}
    assert len(bad & {r.doc_id for r in kept.collect()}) <= 0.1 * len(bad)

    single = materialize(stages["exact"](spark, kept, D), "test-exact")
    first = {}
    for r in sorted(kept.collect()):
        first.setdefault(lower(r.text), r.doc_id)
    assert sorted((lower(r.text), r.doc_id) for r in single.collect()) == sorted(first.items())

    apart = materialize(stages["near"](spark, single, D), "test-near")
    head = linked({r.doc_id: grams(r.text, 5) for r in single.collect()}, 80)
    assert {r.doc_id for r in apart.collect()} == {i for i, h in head.items() if i == h}

    mixed = materialize(stages["mix"](spark, apart, D), "test-mix")
    takes = {r.doc_id: max(r.copies, 1) if r.size == 0 else r.copies for r in mixing.mix(mixing.sized(apart)).collect()}
    assert collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter({i: n for i, n in takes.items() if n})
    assert docs.columns == kept.columns == single.columns == apart.columns == mixed.columns

    out = stages["pack"](spark, mixed, D).collect()
    encode = tokens.encoder(tokens.TOKENIZER).encode_ordinary
    lengths = sorted((r.doc_id, len(encode(r.text or ""))) for r in mixed.collect())
    assert sorted((r.doc_id, r.length) for r in out) == lengths
    counts = collections.Counter(n for _, n in lengths)
    assert sum(r.padded for r in out) == slow_least(np.array(sorted(counts)), np.array([counts[n] for n in sorted(counts)]), 16)


def test_run_is_the_stages(spark, monkeypatch):
    """run() writes each stage and reads it again; the costly stages are tested above."""
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[3:])
    out = corpus_pipeline.run(spark, D)
    assert out.columns == ["doc_id", "length", "bucket", "padded", "batch", "padding"]
    docs = spark.read.parquet(f"{D}/documents.parquet")
    assert out.count() == mixing.mix_documents(docs).count()
