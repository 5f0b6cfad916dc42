"""The pipeline over the smallest tables."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
from clauseloom.llm import registry

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "secrets", "mixing", "packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, FOLDER)
        assert after.schema == docs.schema or after.dtypes == docs.dtypes
        rows = after.collect()
        if name == "secrets":
            assert len(rows) == before.count()
            assert not any(re.search("AKIA[A-Z0-9]{14,}", r["text"] or "") for r in rows)
        if name == "mixing":
            counts = Counter(r["doc_id"] for r in rows)
            assert set(counts) == {r["doc_id"] for r in before.select("doc_id").collect()} and max(counts.values()) <= 2
        before = spark.createDataFrame(rows, docs.schema)


def test_run_packs_every_document_of_the_mix(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    used = Counter()
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    assert all(n <= 2048 for n in used.values()) and sum(n < 2048 for n in used.values()) <= 1


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in registry.QUERIES) == list(range(1, 14))
