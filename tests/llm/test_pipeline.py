import os

import pytest

import corpus_pipeline
from rolesift.llm import dart_minhash, packing, surrogates, template_leaks, weak_quality

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start = docs.count()
    kept = weak_quality.keep_good(docs)
    good = kept.count()
    one = dart_minhash.keep_one(kept)
    assert 0 < good < start and one.count() <= good
    rows = corpus_pipeline.run(spark, SF).collect()
    ids = {r["doc_id"] for r in rows}
    leaks = {r["doc_id"] for r in template_leaks.find_leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert leaks and not ids & leaks
    assert ids <= {r["doc_id"] for r in kept.collect()}
    classes = {r["doc_id"]: r["class_id"] for r in dart_minhash.near_duplicates(kept).collect()}
    assert len({classes[i] for i in ids}) == len(ids)
    clean = surrogates.anonymise(docs.filter(docs["doc_id"].isin(sorted(ids))))
    want = packing.pieces(clean, packing.tokenizer_json()).select("doc_id", "piece", "ids_crc32").collect()
    assert sorted(map(tuple, want)) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows)


def test_empty_and_extra_columns(tricky, spark):
    for rows in (tricky, tricky.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:2] + corpus_pipeline.STAGES[3:4]:
            out = stage(spark, rows, SF)
            assert out.columns == tricky.columns
            out.collect()


def test_batches_are_bounded_by_bytes(spark):
    docs = spark.range(200).coalesce(1).selectExpr("id AS doc_id", "repeat('x', 100000) AS text")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for _, stage in corpus_pipeline.STAGES[:1]:
            stage(spark, docs, SF)
        sizes = docs.mapInArrow(lambda batches: (type(b).from_pydict({"n": [b.nbytes]}) for b in batches), "n long")
        assert max(r["n"] for r in sizes.collect()) < 5 << 20
    finally:
        spark.conf.set(key, before)
