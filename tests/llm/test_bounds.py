"""Bounds that hold for ids that stand very often, counts beyond 32 bits, votes among ties."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessella.llm import common, language_model, quality, toxicity


def test_an_id_that_stands_often_is_learned_from_once(spark):
    hot = spark.range(100_000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("some words of copy "), (F.col("id") % 7).cast("string")).alias("text"))
    docs = hot.unionByName(spark.createDataFrame([(1, "one good text"), (2, "a bad text"), (9, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(5, 1, 0), (1, 0, 1), (2, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    chosen = common.one_text_each(docs).collect()
    assert len(chosen) == 4 and {r["text"] for r in chosen if r["doc_id"] == 9} == {None}
    assert common.one_text_each(docs.repartition(9)).orderBy("doc_id").collect() == sorted(chosen, key=lambda r: r["doc_id"])
    voters = quality.train_voters(docs, labels, sample=2)
    assert len(voters.y) <= 2 and len(voters.space.labelled) == len(voters.y)
    seen = []
    fit = toxicity.Chain.fit
    toxicity.Chain.fit = lambda self, rows, *a: seen.append(len(rows)) or fit(self, rows, *a)
    try:
        toxicity.train_chain(docs, toxicity.label_categories(labels), toxicity.CATEGORIES, sample=3)
    finally:
        toxicity.Chain.fit = fit
    assert seen == [3]


def test_pair_counts_beyond_32_bits(tmp_path):
    a, b = np.array([1, 1, 1, 2, 3], np.uint64), np.array([5, 6, 7, 5, 9], np.uint64)
    n = np.array([1, 2**32 - 2, 2**32 - 1, 2**40, 3], np.int64)
    row = {"a": a.tobytes(), "runs": np.ones(5, "<u4").tobytes(), "low": b.astype("<u4").tobytes(), "high": np.zeros(5, "<u2").tobytes(),
           "small": np.minimum(n, 255).astype("u1").tobytes(), "large": n[n > 254].astype("<i8").tobytes()}
    twice = pd.DataFrame([row, row])  # counts of two tasks are added
    language_model._store_pairs(str(tmp_path))((0,), twice)
    model = language_model.Model(str(tmp_path), np.zeros(0, np.uint64), 1, 1, 1, 1, [0] * 4, [1], ((0.5,) * 3, (0.5,) * 3))
    found = model.pairs(np.r_[a, np.uint64(4)], language_model.pair_key(np.r_[a, np.uint64(4)], np.r_[b, np.uint64(4)]))
    assert found.tolist() == [*(2 * n).tolist(), 0]


def test_votes_among_ties_go_by_place():
    rng = np.random.default_rng(8)
    space = quality.Space.__new__(quality.Space)
    points = rng.standard_normal((40, 6)).astype(np.float32)
    space.labelled = quality.Space._unit(points[rng.integers(0, 12, 300)])  # each stands many times, under both labels
    y = rng.integers(0, 2, 300).astype(float)
    voters = quality.Voters(space, y, 25)
    asked = quality.Space._unit(points)
    got = voters.vote(asked)
    for p, score in zip(asked.astype(float), got, strict=True):
        sims = np.round(space.labelled.astype(float) @ p, 12)
        near = np.lexsort((np.arange(300), -sims))[:25]
        w = np.maximum(sims[near], 0) ** quality.SHARP
        assert abs(score - (w @ y[near] / w.sum() if w.sum() else y.mean())) < 1e-12
    assert np.array_equal(voters.vote(asked[::-1]), got[::-1])
