"""Search in blocks of rows and queries: what it returns is what all pairs would give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import position, retrieval


def rows(df):
    return sorted(map(repr, df.collect()))


def by_pairs(base, queries, k):
    pairs = base.join(queries, F.col("vec_id") != F.col("query")).select("query", "vec_id", F.round(retrieval.dot(F.col("embedding"), F.col("q")), 9).alias("score"))
    return position.top(pairs, "query", [F.desc("score"), F.col("vec_id")], k).withColumn("rank", F.col("rank") - 1)


@pytest.mark.parametrize("k", [3, 40, 400])
def test_blocks_equal_pairs(spark, monkeypatch, k):
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 60)
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 9)
    rng = np.random.default_rng(5)
    vectors = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(150)]  # many ties
    vectors += [(200 + i, [1.0, 2.0, 0.5, 1e-10 * i]) for i in range(60)] + [(300 + i // 3, [1.0, 2.0, 2.0, 2.0]) for i in range(60)]
    vectors += [(400, None), (401, [1.0, None, 2.0, 3.0]), (402, [1.0, 2.0]), (403, []), (404, [float("nan"), 1.0, 1.0, 1.0]), (405, [float("inf"), 1.0, 1.0, 1.0]), (406, [0.0] * 4), (None, [9.0] * 4)]
    base = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    queries = base.where("vec_id % 10 = 0 OR vec_id >= 400").dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    got = retrieval.dense_top(base, queries, "vec_id", "embedding", k)
    assert rows(got.select("query", "vec_id", "score", "rank")) == rows(by_pairs(base, queries, k).select("query", "vec_id", "score", "rank"))
    named = lambda df: df.withColumn("vec_id", F.concat(F.lit("é"), F.col("vec_id").cast("string")))
    got = retrieval.dense_top(named(base), named(queries.withColumnRenamed("query", "vec_id")).withColumnRenamed("vec_id", "query"), "vec_id", "embedding", k)
    assert got.count() == by_pairs(base, queries, k).count()


def test_pairs_are_not_dealt(spark):
    base = spark.range(50).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    queries = base.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    assert "Join" not in retrieval.dense_top(base, queries, "vec_id", "embedding", 3)._jdf.queryExecution().executedPlan().toString()




def test_candidates_are_made_once(spark):
    made = spark.range(12).selectExpr("0 AS query", "id AS k", "id / 20.0D AS score", "array(1.0D, id / 10.0D) AS v")
    made = made.mapInArrow(lambda batches: batches, made.schema)
    chosen = retrieval.diverse(made, "k", "v", 3)
    assert chosen.count() == 3 and "MapInArrow" not in chosen._jdf.queryExecution().executedPlan().toString()
