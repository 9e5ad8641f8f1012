"""Boosting is dealt to tasks by rows, not bytes, and scores are computed once."""

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import boosting


def frame(spark, n):
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, rng.standard_normal(2)), i % 3, 1.0) for i in range(n)]
    return spark.createDataFrame(rows, "id long, f0 double, f1 double, y int, w double")


def largest_task(state):
    return state.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]


def test_few_bytes_go_to_many_tasks(spark, monkeypatch):
    df = frame(spark, 320).coalesce(1)
    monkeypatch.setattr(boosting, "TASK_ROWS", 40, raising=False)
    state, _, _ = boosting.started(df, ["f0", "f1"], "y", ["w"], 3)
    assert state.count() == 320 and largest_task(state) <= 80


def test_a_score_is_computed_once(spark):
    df = frame(spark, 60)
    fitted = boosting.fit(df, ["f0", "f1"], "y", ["w"], 3, rounds=2, depth=2)[0]
    plan = boosting.predict(fitted, df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(_trees") == 1
