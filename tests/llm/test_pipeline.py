"""The pipeline's stages, one after the other, on the smallest table."""

from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from docspend.llm.common import table, written
from docspend.llm.tokens import Encoder

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_each_stage_takes_effect(spark):
    docs = table(spark, DATA, "documents")
    names = docs.columns
    after = {"": docs.toPandas()}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DATA), "test")
        after[name] = docs.toPandas()
    first, kept, unique, near, mixed, packed = after.values()
    for x in (kept, unique, near, mixed):
        assert list(x.columns) == names
    labels = table(spark, DATA, "labels").toPandas().set_index("doc_id").quality
    good = set(labels[labels == 1].index)
    assert len(good & set(kept.doc_id)) > 0.95 * len(good & set(first.doc_id))
    assert len(kept) < len(first)
    assert unique.text.is_unique and set(unique.text) == set(kept.text)
    assert set(near.doc_id) <= set(unique.doc_id)
    copies = Counter(mixed.doc_id)
    assert set(copies) <= set(near.doc_id) and max(copies.values()) <= 3
    enc = Encoder()
    size = {r.doc_id: len(enc.whole(r.text)) + 1 for r in near.itertuples()}
    assert packed.length.sum() == sum(size[i] * c for i, c in copies.items())
    assert packed.groupby("sequence_id").length.sum().max() <= 1024


def test_empty_documents(spark):
    empty = table(spark, DATA, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = written(stage(spark, empty, DATA), "test")
        assert empty.count() == 0
