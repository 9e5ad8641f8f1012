"""Splines through many series at once: the values of one series at a time."""

import numpy as np

from tessella.operators import series


def one(v, max_gap):
    seen, out = np.flatnonzero(~np.isnan(v)), v.copy()
    for left, right in zip(seen[:-1], seen[1:], strict=True):
        if 1 <= right - left - 1 <= max_gap:
            at = np.arange(left + 1, right)
            out[at] = series.natural_spline(seen, v[seen], at) if len(seen) >= 4 else np.interp(at, seen, v[seen])
    return out


def test_all_series_at_once(spark):
    rng = np.random.default_rng(8)
    cells = {(p, m): np.where(rng.random(d) < rng.choice([0.05, 0.4, 0.8]), rng.normal(50, 20, d), np.nan) for p in range(40) for m, d in (("a", 30), ("b", 9), ("c", 2 + p % 4))}
    rows = [(p, m, int(i) + 1, None if np.isnan(x) else float(x)) for (p, m), v in cells.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "patient int, measure string, day int, value double").repartition(3)
    done = series.impute_spline(df, 3)
    assert "FlatMapGroupsInPandas" not in done._jdf.queryExecution().executedPlan().toString()
    got = {(r["patient"], r["measure"], r["day"]): (r["value"], r["imputed"]) for r in done.collect()}
    assert len(got) == len(rows)
    for (p, m), v in cells.items():
        for i, (before, want) in enumerate(zip(v, one(v, 3), strict=True)):
            value, imputed = got[p, m, i + 1]
            assert imputed == int(np.isnan(before) and not np.isnan(want))
            assert value is None if np.isnan(want) else abs(value - want) < 1e-9
