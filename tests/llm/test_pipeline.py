"""The corpus pipeline, stage by stage, against brute force on a small table."""

import re

import pytest

import corpus_pipeline
from cellscope.llm import pii
from cellscope.llm._common import documents, stored


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = documents(spark, sf), [documents(spark, sf)]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), "test-" + name.replace(" ", "-"))
        out.append(docs)
    return out


def test_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "pii", "mixing", "packing"]
    for after in stages[1:5]:
        assert after.columns == stages[0].columns


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_quality_keeps_labelled_documents(spark, sf, stages):
    """Rows that are labelled as good and pass the base rules are all kept, with their texts."""
    before, after = texts(stages[0]), texts(stages[1])
    assert set(after) <= set(before)
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    long_enough = {i for i in good if len(before[i].split()) >= 50}
    assert long_enough <= set(after)
    assert all(len(t.split()) >= 1 for t in after.values())


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_duplicates_go(stages):
    before, after = texts(stages[1]), texts(stages[2])
    sets = {i: shingles(t) for i, t in before.items()}
    similar = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    kept = sorted(after)
    for n, i in enumerate(kept):
        for j in kept[:n]:
            if sets[i] & sets[j]:
                assert similar(i, j) < 0.8
    for i in set(before) - set(after):
        assert max(similar(i, j) for j in before if j != i) >= 0.8


def test_personal_data_is_masked(stages):
    before, after = texts(stages[2]), texts(stages[3])
    assert set(before) == set(after)
    for i, t in after.items():
        assert pii.base_spans(t) == []
        if not pii.base_spans(before[i]) and not re.search("[0-9=:]", before[i]):
            assert t == before[i]


def test_mixing_repeats_whole_documents(stages):
    before = texts(stages[3])
    rows = stages[4].groupBy("doc_id").count().collect()
    assert all(r["doc_id"] in before and r["count"] <= 3 for r in rows)
    assert set(texts(stages[4]).items()) <= set(before.items())


def test_packing_holds_every_document(stages):
    pieces = stages[5].groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    copies = {r["doc_id"]: r["count"] for r in stages[4].groupBy("doc_id").count().collect()}
    assert {r["doc_id"] for r in pieces} == set(copies)
    assert all(r["sum(length)"] == r["max(doc_tokens)"] * copies[r["doc_id"]] for r in pieces)


def test_run(spark, sf, stages):
    assert corpus_pipeline.run(spark, sf).count() == stages[5].count()
