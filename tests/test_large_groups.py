"""What is ranked in one task where groups are small, and in ranges where they aren't, is the same."""

import math

import numpy as np
import pytest

from tessella.operators import cohort, evaluate, position


def rows(df):
    return sorted(tuple(None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.fixture(scope="module")
def obs(spark):
    rng = np.random.default_rng(1)
    cells = [(p, m, d, None if rng.random() < 0.2 else float(rng.integers(0, 12)), 1 + p % 3) for p in range(60) for m in ("a", "b") for d in (1, 2)]
    cells += [(p, "c", 1, None, 1 + p % 3) for p in range(3)]
    return spark.createDataFrame(cells, "patient int, measure string, day int, value double, class int")


def test_both_ways_agree(spark, obs, monkeypatch):
    answers = spark.createDataFrame([(f"PLT 30 word {'x ' * (i % 9)}" if i % 5 else None, 1 + i % 3 if i % 4 else None, float(i * 7 % 31)) for i in range(90)], "answer string, predicted int, latency_ms double")
    made = [
        lambda: cohort.daily_stats(obs), lambda: position.cube(obs), lambda: position.percentiles(obs.where("patient % 20 = 0"), obs),
        lambda: evaluate.answers(answers), lambda: evaluate.latency(answers), lambda: position.quantiles(obs, [], "value", {"q": 0.3}),
        lambda: position.ranges(obs, ["measure"], "value"), lambda: evaluate.latency(answers.limit(0)),
    ]
    small = [rows(f()) for f in made]
    for module in (position, evaluate):
        monkeypatch.setattr(module, "IN_TASK", 5)
    for one, f in zip(small, made, strict=True):
        assert rows(f()) == [tuple(pytest.approx(v) if isinstance(v, float) else v for v in r) for r in one]
