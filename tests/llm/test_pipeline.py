"""Every stage of the corpus pipeline on its own input, against a plain version."""

import re

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from repsight.llm import quality

from .conftest import SMALL
from .test_packing import check
from .test_secrets import HARD, plain
from .test_simhash import slow_components, slow_fingerprint

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def mixed(spark, odd_docs):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    more = [(1000 + i, t, None, None, len(t)) for i, t in enumerate(HARD)]
    odd = odd_docs.where("doc_id is not null and doc_id != 6").withColumn("doc_id", F.col("doc_id") + 2000)
    return docs.unionByName(odd).unionByName(
        spark.createDataFrame(more, docs.schema)
    ).cache()


def test_language_stage(spark, mixed):
    before = mixed.collect()
    after = STAGES["language ID"](spark, mixed, SMALL).collect()
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert {r.doc_id for r in before if not re.search(r"[^\W\d_]", r.text or "")} <= gone
    assert not {r.doc_id for r in before if r.doc_id < 900 and r.lang and r.text and len(r.text) > 50} & gone
    assert all(r.lang for r in after)


def test_quality_stage(spark, mixed):
    model = quality.train(mixed, spark.read.parquet(f"{SMALL}/labels.parquet"))
    want = {r.doc_id for r in mixed.collect() if model.scores([(r.text or "").encode()])[0] >= 0.3}
    got = {r.doc_id for r in STAGES["quality classifier"](spark, mixed, SMALL).collect()}
    # a text scored alone or in a batch can differ in the last bits of a float
    assert len(want ^ got) <= 1 and len(got) > 100


def test_dedup_stage(spark, mixed):
    rows = mixed.collect()
    comp = slow_components([r.doc_id for r in rows], [slow_fingerprint(r.text) for r in rows], 4)
    got = STAGES["SimHash near-dedup"](spark, mixed, SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(set(comp))


def test_secrets_stage(spark, mixed):
    before = {r.doc_id: r for r in mixed.collect()}
    after = STAGES["secret scans"](spark, mixed, SMALL).collect()
    assert len(after) == len(before)
    for r in after:
        spans = plain(before[r.doc_id].text)
        assert (r == before[r.doc_id]) == (not spans)
        for s, e, _ in spans:
            assert e - s < 12 or before[r.doc_id].text[s:e] not in r.text


def test_packing_stage(spark, mixed):
    pieces = STAGES["packing"](spark, mixed, SMALL).collect()
    check(pieces, {r.doc_id: r.text for r in mixed.collect()})


def test_run_applies_all_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).checkpoint()
        assert docs.columns == corpus_pipeline.COLUMNS
    got = corpus_pipeline.run(spark, SMALL).collect()
    check(got, {r.doc_id: r.text for r in docs.collect()})


def test_empty_table(spark, no_docs):
    docs = no_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0, name


def test_stages_leave_out_extra_columns_of_any_name(spark, mixed):
    some = mixed.limit(30).cache()
    clash = some
    for name in ("row", "score", "lang_pred", "quality_score", "secret_spans", "clean", "some", "given", "key", "ids"):
        clash = clash.withColumn(name, F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got, want = stage(spark, clash, SMALL), stage(spark, some, SMALL)
        assert got.columns == corpus_pipeline.COLUMNS and sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name
        assert stage(spark, some.limit(0), SMALL).count() == 0
