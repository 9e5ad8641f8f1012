"""Labels of the nearest embeddings: every row of the table asks, and every other row may answer."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import position, retrieval
from tessella.plans import search


def test_labels_for_every_row(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/embeddings.parquet").orderBy("vec_id").collect()
    ids, labels, x = np.array([r["vec_id"] for r in rows]), np.array([r["label"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    want = {}
    for i, q in enumerate(ids):
        score = np.round((x * x[i]).sum(1), 9)
        first = [j for j in np.lexsort((ids, -score)) if j != i][:10]
        for label, n in zip(*np.unique(labels[first], return_counts=True), strict=True):
            want[int(q), int(label)] = int(n)
    got = search.QUERIES["nearest_embedding_labels"][0](spark, tiny).collect()
    assert {r["query"] for r in got} == set(ids.tolist())
    assert {(r["query"], r["label"]): r["n"] for r in got} == want


def test_sql_asks_for_every_row():
    assert "% 100" not in search.QUERIES["nearest_embedding_labels"][1]
    assert all("a.vec_id % 100 = 0" in search.QUERIES[name][1] for name in ("dense_topk", "stored_dense_topk", "rerank_threshold", "rrf_fusion", "mmr_select"))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_blocks_equal_pairs_when_all_ask(spark, monkeypatch, kind):
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 700)
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 300)
    rng = np.random.default_rng(7)
    vectors = [(i, rng.standard_normal(3).tolist()) for i in range(1200)] + [(1200 + i, [0.5, 0.25, 1.0]) for i in range(90)]
    vectors += [(1300 + i, [0.0] * 3) for i in range(9)] + [(1320 + i, [float("nan"), 1.0 * i, 0.0]) for i in range(9)] + [(1340 + i, [float("inf"), 1.0 * i, 0.0]) for i in range(3)]
    vectors += [(1400 + i, None) for i in range(4)] + [(1410, [1.0, None, 2.0]), (1411, [1.0, 2.0]), (1412, []), (None, [9.0] * 3), (-7, [3.0, 3.0, 3.0]), (-7, [-3.0, 3.0, 3.0])]
    base = spark.createDataFrame(vectors, f"vec_id long, embedding array<{kind}>")
    queries = base.select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    pairs = base.join(queries, F.col("vec_id") != F.col("query")).select("query", "vec_id", F.round(retrieval.dot(F.col("embedding"), F.col("q")), 9).alias("score"))
    want = position.top(pairs, "query", [F.desc("score"), F.col("vec_id")], 2).withColumn("rank", F.col("rank") - 1)
    got = retrieval.dense_top(base, queries, "vec_id", "embedding", 2).select("query", "vec_id", "score", "rank")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select("query", "vec_id", "score", "rank").collect()))


def test_groups_of_rows_lose_no_candidate():
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (2600, 5)).astype(float)
    x[::7] += rng.standard_normal((len(x[::7]), 5))
    q = x[:300]
    begin = np.arange(300)
    a, b, product = retrieval._best_products(x, q, begin, begin + 1, 10)
    for i in range(300):
        mine = x @ q[i]
        mine[i] = -np.inf
        assert np.allclose(np.sort(product[a == i])[::-1][:10], np.sort(mine)[::-1][:10])
        assert i not in b[a == i]


@pytest.mark.parametrize("scale", [1.0, 1e-12, 1e18, 1e100])
@pytest.mark.parametrize("far", [1.0, 1000.0])
def test_rounding_of_single_precision_loses_no_candidate(scale, far):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.standard_normal((80, 6)), 30, 0) + 1e-8 * rng.standard_normal((2400, 6))  # single precision can't part these
    x[5] *= far
    x *= scale
    q, begin = x[:40], np.arange(40)
    with np.errstate(over="ignore", invalid="ignore"):
        a, b, product = retrieval._best_products(x, q, begin, begin + 1, 10)
        for i in range(40):
            mine = sum(x[:, d] * q[i, d] for d in range(6))
            mine[i] = -np.inf
            kth = np.sort(mine)[-10]
            assert set(np.flatnonzero(mine > kth)) <= set(b[a == i]) and (product[a == i] >= kth).sum() >= 10
