"""Stored indexes: the same results as scans, parts read only, changed corpora and stopped builds noticed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import position, retrieval, stored


def rows(df):
    return sorted(tuple(r) for r in df.collect())


WORDS = [f"w{i}" for i in range(60)]


def texts(spark, n, first=0):
    rng = np.random.default_rng(first)
    made = [(first + i, " ".join(rng.choice(WORDS, int(rng.integers(1, 40)), p=np.arange(60, 0, -1) / 1830))) for i in range(n)]
    return spark.createDataFrame([*made, (first + n, ""), (first + n + 1, None)], "doc_id long, text string")


def test_postings_are_counted_in_the_row(spark):
    docs = texts(spark, 50)
    want = [(k, w, t.split().count(w), len(t.split())) for k, t in docs.collect() for w in set((t or "").split())]
    assert rows(retrieval.postings(docs, "doc_id", "text").select("doc_id", "term", "tf", "size")) == sorted(want)
    assert "Exchange" not in retrieval.postings(docs, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    n, mean = retrieval.corpus_size(docs, "text")
    assert n == 52 and mean == round(sum(len((t or "").split()) for _, t in docs.collect()) / 52, 9)
    assert retrieval.corpus_size(docs.limit(0), "text") == (0, 1.0)


def test_term_index_grows_and_reads_few_buckets(spark, tmp_path):
    path = f"{tmp_path}/terms"
    a, b = texts(spark, 150), texts(spark, 100, 1000)
    both = a.unionByName(b)
    queries = spark.createDataFrame([(1, "w3"), (1, "w50"), (2, "w59"), (2, "absent")], "query int, term string")
    stored.TermIndex.add(path, a, buckets=8)
    stored.TermIndex.add(path, b)
    index = stored.TermIndex.open(spark, path, both)
    want = retrieval.bm25(retrieval.postings(both, "doc_id", "text"), *retrieval.corpus_size(both, "text"), queries, "doc_id", 7)
    assert (index.n_docs, index.mean_size) == retrieval.corpus_size(both, "text")
    assert rows(index.search(queries, 7)) == rows(want) and want.count() > 7
    bucket = [r[0] for r in queries.where("term = 'w3'").select(stored._bucket("term", 8)).collect()]
    plan = index._read("postings", bucket)._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert {r[0].split("bucket=")[1].split("/")[0] for r in index._read("postings", bucket).select(F.input_file_name()).distinct().collect()} == {str(bucket[0])}
    assert {r[0] for r in index._read("postings", bucket).select("term").distinct().collect()} == {w for w in WORDS if [r[0] for r in spark.createDataFrame([(w,)], "term string").select(stored._bucket("term", 8)).collect()] == bucket}


def test_changed_corpora_and_stopped_builds(spark, tmp_path, monkeypatch):
    path, docs = f"{tmp_path}/terms", texts(spark, 30)
    with pytest.raises(stored.StaleIndex):
        stored.TermIndex.open(spark, path)
    commit = stored._commit

    def stop(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(stored, "_commit", stop)
    with pytest.raises(KeyboardInterrupt):
        stored.TermIndex.add(path, docs, buckets=4)
    monkeypatch.setattr(stored, "_commit", commit)
    with pytest.raises(stored.StaleIndex):
        stored.TermIndex.open(spark, path)
    stored.TermIndex.add(path, docs, buckets=4)  # what the stopped build left isn't read
    index = stored.TermIndex.open(spark, path, docs)
    queries = spark.createDataFrame([(1, "w0")], "query int, term string")
    want = retrieval.bm25(retrieval.postings(docs, "doc_id", "text"), *retrieval.corpus_size(docs, "text"), queries, "doc_id", 50)
    assert rows(index.search(queries, 50)) == rows(want)
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 3, F.lit("other")).otherwise(F.col("text")))
    for other in (changed, docs.limit(5), docs.union(docs.limit(1))):
        with pytest.raises(stored.StaleIndex):
            stored.TermIndex.open(spark, path, other)
    with pytest.raises(stored.StaleIndex):
        stored.VectorIndex.open(spark, path)
    monkeypatch.setattr(stored, "VERSION", 2)
    with pytest.raises(stored.StaleIndex):
        stored.TermIndex.open(spark, path)


@pytest.mark.parametrize("spread", [0.05, 5.0])
def test_vector_index_equals_a_scan(spark, tmp_path, spread):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 6)) * 3
    vectors = [(i, (centres[i % 12] + spread * rng.standard_normal(6)).tolist()) for i in range(600)] + [(700 + i, [1.0] * 6) for i in range(40)] + [(900, [0.0] * 6), (901, None)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    index = stored.VectorIndex.build(f"{tmp_path}/v", df)
    queries = df.where("vec_id % 50 = 0 AND embedding IS NOT NULL").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    want = retrieval.dense_top(df.where("embedding IS NOT NULL"), queries, "vec_id", "embedding", 9)
    assert rows(stored.VectorIndex.open(spark, f"{tmp_path}/v", df).search(queries, 9)) == rows(want)
    assert index.search(queries, 1000).count() == queries.count() * 640
    share = index.share_read(queries, 9)
    assert share < 0.6 if spread < 1 else share <= 1
    with pytest.raises(stored.StaleIndex):
        stored.VectorIndex.open(spark, f"{tmp_path}/v", df.limit(100))


def test_queries_beyond_the_bounds_go_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.standard_normal(4).tolist()) for i in range(60)], "vec_id long, embedding array<double>")
    queries = df.where("vec_id < 20").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    want = rows(retrieval.dense_top(df, queries, "vec_id", "embedding", 3))
    monkeypatch.setattr(position, "BROADCAST_BYTES", 400)
    assert len(position.query_blocks(queries, "query")) > 3
    got = retrieval.dense_top(df, queries, "vec_id", "embedding", 3)
    assert rows(got) == want and "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString()
    assert position.if_small(queries) is queries
