import pytest

import corpus_pipeline
from eponym.llm import op3_toxicity, op6_quality_rules

from .test_text_operators import brute_components


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).toPandas())
        out.append(docs.collect())
    return out


def test_each_stage(spark, sf_dir, steps):
    documents, good, civil, single, packed = steps
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "near_duplicates", "packing"]
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert {r["doc_id"] for r in good} == {r["doc_id"] for r in op6_quality_rules.judge(frame).where("kept").collect()}
    assert set(good[0].asDict()) == set(documents[0].asDict())
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    gone = {r["doc_id"] for r in good} - {r["doc_id"] for r in civil}
    toxic = [r["doc_id"] for r in good if labels.get(r["doc_id"]) == 1]
    clean = [r["doc_id"] for r in good if labels.get(r["doc_id"]) == 0]
    assert sum(i in gone for i in toxic) >= 0.5 * len(toxic) and sum(i in gone for i in clean) <= 0.1 * len(clean)
    want = brute_components([(r["doc_id"], r["text"]) for r in civil], 80, 5)
    assert sorted(r["doc_id"] for r in single) == sorted({c for _, c in want.values()})
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in single}


def test_run_gives_the_same(spark, sf_dir, steps):
    key = lambda rows: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(corpus_pipeline.run(spark, sf_dir).collect()) == key(steps[-1])


def test_stages_take_empty_and_odd_tables(spark, sf_dir, make, texts):
    for docs in (make([]), make(texts)):
        for _, stage in corpus_pipeline.STAGES[:3]:
            docs = stage(spark, docs, sf_dir)
        corpus_pipeline.STAGES[3][1](spark, docs, sf_dir).count()


def test_model_is_small():
    assert len(__import__("pickle").dumps(op3_toxicity.Model())) < 10_000
