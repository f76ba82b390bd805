"""The pipeline on the smallest tables, stage by stage."""

import pytest
from llm_frames import EMPTY, frame

import corpus_pipeline
from corpusloom.llm import packing, secret_scan, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        found.append(docs)
    return found


def test_stages_return_documents(steps):
    for before, after in zip(steps[:-2], steps[1:-1], strict=True):
        assert after.columns == steps[0].columns
        assert after.count() > 0
        assert after.join(before, "doc_id", "left_anti").count() == 0


def test_classifier_keeps_the_good(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = steps[0].join(labels.where("quality = 1"), "doc_id")
    assert steps[1].join(good, "doc_id", "left_semi").count() >= 0.97 * good.count()


def test_dedup_leaves_the_smallest_of_each_group(steps):
    groups = simhash.near_duplicates(steps[1], 3).collect()
    assert sorted(r["doc_id"] for r in steps[2].collect()) == sorted({r["component_id"] for r in groups})


def test_no_secret_is_left(steps):
    assert steps[3].count() == steps[2].count()
    assert secret_scan.scan(steps[3]).where("size(spans) > 0").count() == 0


def test_packing_takes_every_document(steps):
    pieces = steps[5].collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in steps[4].collect()}
    whole = {r["doc_id"]: r["doc_tokens"] for r in pieces}
    assert sum(r["length"] for r in pieces) == sum(whole.values())
    assert max(r["offset"] + r["length"] for r in pieces) <= packing.SEQUENCE


def test_run_is_the_stages_in_order(spark, steps):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, steps[5].collect()))


def test_awkward_and_empty_tables(spark):
    for rows in (None, EMPTY):
        docs = frame(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == docs.columns
        for _, stage in corpus_pipeline.STAGES:
            kept = stage(spark, docs, SF).count()
            assert kept == 0 if rows == EMPTY else kept >= 0
