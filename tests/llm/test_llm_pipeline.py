"""The pipeline against its stages done one after the other in plain Python."""

import pytest
from test_llm_operators import brute_contamination, brute_quality, brute_simhash, reference

import corpus_pipeline
from chronoloom.llm import pii
from chronoloom.llm.shared import table


@pytest.fixture(scope="module")
def result(spark, sf):
    return corpus_pipeline.run(spark, sf)


def test_pipeline_brute(spark, sf, result):
    read = lambda name, *columns: [tuple(r) for r in table(spark, sf, name).select(*columns).collect()]
    own = read("documents", "doc_id", "text")
    trusted = {i for i, q, t in read("labels", "doc_id", "quality", "toxic") if q == 1 and t == 0}
    own = [d for d, r in zip(own, brute_quality(own, trusted), strict=True) if r[-1]]
    own = [d for d, r in zip(own, brute_simhash(own), strict=True) if r[2] == d[0]]
    own = [d for d, r in zip(own, brute_contamination(own, read("benchmark", "item_id", "text")), strict=True) if not r[-1]]
    frame = spark.createDataFrame(own, "doc_id bigint, text string")
    own = [(r["doc_id"], r["text"]) for r in pii.redact(frame).collect()]
    assert not any(pii.base_spans(t) for _, t in own)
    coder = reference()
    expected = {i: (t, len(t), coder.encode_ordinary(t)) for i, t in own}
    assert {r["doc_id"]: (r["text"], r["n_chars"], r["ids"]) for r in result.collect()} == expected


def test_stages_keep_the_columns(spark, sf):
    docs = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_stages_take_awkward_rows(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "x y z " * 9, "en", "a", 54), (3, "x y z " * 9, "en", "a", 54)]
    docs = spark.createDataFrame(rows, table(spark, sf, "documents").schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() <= len(rows), name
        assert stage(spark, docs.where("false"), sf).count() == 0, name
