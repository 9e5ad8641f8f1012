"""Postings are counted in Arrow batches: no function runs for each word, and batches leave no trace."""

import pytest

from tessella.operators import retrieval


@pytest.mark.parametrize("key", ["long", "string"])
def test_postings_by_batches(spark, key):
    texts = ["b a b", "", None, "A é_1 a", "ΣΑΣ σας 𝒳 x٣", "...", "a " * 500, "b a b", *[f"w{i} w{i % 3}" for i in range(20)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr(f"CAST(doc_id AS {key}) AS doc_id", "text").coalesce(1)
    words = docs.select("doc_id", retrieval.X.words(docs["text"]).alias("w")).collect()
    want = sorted((r.doc_id, len(r.w), t, r.w.count(t)) for r in words for t in set(r.w or []))
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(most)
    try:
        for n in ("3", "10000"):
            spark.conf.set(most, n)
            got = retrieval.postings(docs, "doc_id", "text")
            assert sorted(map(tuple, got.select("doc_id", "size", "term", "tf").collect())) == want
    finally:
        spark.conf.set(most, old)
    assert dict(got.dtypes) == {"doc_id": dict(docs.dtypes)["doc_id"], "size": "int", "term": "string", "tf": "bigint"}
    assert retrieval.postings(docs.limit(0), "doc_id", "text").count() == 0
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
