"""Boosted trees against a NumPy version that sees all rows at once."""

import math

import numpy as np
import pytest

from tessella.operators import boosting, model


def numpy_fit(x, y, w, classes, edges, rounds, depth, rate=0.1, ridge=1.0, least=5):
    """Rounds of [{node: (feature, cut, missing left)}, {leaf: value}] by class, and the scores of all rows."""
    share = np.array([w[y == k].sum() for k in range(classes)]) / w.sum()
    scores = np.tile(np.log(share), (len(y), 1))
    bins = np.array([[-1 if math.isnan(v) else sum(e < v for e in edges[f]) for f, v in enumerate(r)] for r in x])
    out, gains, inside = [], np.zeros(x.shape[1]), w > 0
    for _ in range(rounds):
        p = np.exp(scores - scores.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        step, trees = np.zeros_like(scores), []
        for k in range(classes):
            g, h = w * (p[:, k] - (y == k)), w * classes / (classes - 1) * p[:, k] * (1 - p[:, k])
            node, cuts, values = np.zeros(len(y), int), {}, {}
            for level in range(depth):
                for i in np.unique(node[inside & (node >= 2**level - 1)]):
                    rows, best = inside & (node == i), None
                    for f in range(x.shape[1]):
                        for b in range(len(edges[f]) + 1):
                            for missing in (False, True):
                                left = rows & ((bins[:, f] >= 0) & (bins[:, f] <= b) | (bins[:, f] < 0) & missing)
                                right = rows & ~left
                                if min(left.sum(), right.sum()) < least or min(h[left].sum(), h[right].sum()) < 1e-3:
                                    continue
                                gain = sum(s * g[q].sum() ** 2 / (h[q].sum() + ridge) for q, s in ((left, 1), (right, 1), (rows, -1)))
                                if best is None or round(gain, 9) > round(best[0], 9):
                                    best = (gain, f, b, missing, left, right)
                    if best and best[0] > 1e-9:
                        gain, f, b, missing, left, right = best
                        cuts[int(i)] = (f, b, missing)
                        gains[f] += gain
                        for q, j in ((left, 2 * i + 1), (right, 2 * i + 2)):
                            values[int(j)] = -rate * g[q].sum() / (h[q].sum() + ridge)
                for i, (f, b, missing) in cuts.items():
                    here = node == i
                    goes = (bins[:, f] >= 0) & (bins[:, f] <= b) | (bins[:, f] < 0) & missing
                    node = np.where(here, np.where(goes, 2 * i + 1, 2 * i + 2), node)
            step[:, k] = [values.get(int(i), 0.0) for i in node]
            trees.append(cuts)
        scores += step
        out.append(trees)
    return out, scores, gains


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = np.round(rng.standard_normal((240, 4)), 1)
    y = (x[:, 0] + 0.5 * x[:, 1] > 0.3).astype(int) + (x[:, 2] > 0.8)
    x[rng.random((240, 4)) < 0.2] = math.nan
    x[:, 3][y == 2] = math.nan  # what is missing tells a class
    return x, y


def frame(spark, x, y, **weights):
    rows = [(i, *[None if math.isnan(v) else float(v) for v in r], int(k), *[float(w[i]) for w in weights.values()]) for i, (r, k) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, f0 double, f1 double, f2 double, f3 double, y int" + "".join(f", {w} double" for w in weights))


FEATURES = ["f0", "f1", "f2", "f3"]


def test_trees_equal_numpy(spark, data):
    x, y = data
    weights = {"a": np.ones(240), "b": np.where(np.arange(240) % 3, 1.0 + (y == 2), 0.0)}
    df = frame(spark, x, y, **weights)
    edges = [[-1.0, -0.5, 0.0, 0.5, 1.0]] * 4
    models = boosting.fit(df, FEATURES, "y", list(weights), 3, rounds=3, depth=2, edges=edges)
    for got, w in zip(models, weights.values(), strict=True):
        trees, scores, gains = numpy_fit(x, y, w, 3, edges, 3, 2)
        for mine, want in zip(got.trees, trees, strict=True):
            for tree, cuts in zip(mine, want, strict=True):
                found = {i: (f, tree["cut"][i], tree["left"][i]) for i, f in enumerate(tree["feature"]) if f >= 0}
                assert found == {i: (f, edges[f][b] if b < 5 else math.inf, m) for i, (f, b, m) in cuts.items()}
        np.testing.assert_allclose(got.gains, gains, rtol=1e-9)
        p = np.exp(scores - scores.max(1, keepdims=True))
        said = {r["id"]: r for r in boosting.predict(got, df).collect()}
        np.testing.assert_allclose([said[i]["probability"] for i in range(240)], p / p.sum(1, keepdims=True), rtol=1e-9)
        assert [said[i]["predicted"] for i in range(240)] == np.argmax(p, 1).tolist()


def test_missing_values_are_learnt_from(spark, data):
    x, y = data
    fitted = model.fit_boosted(frame(spark, x, y), FEATURES, "y", 3, rounds=8)
    said = boosting.predict(fitted, frame(spark, x, y))
    assert said.where("predicted = y").count() > 0.85 * 240
    again = boosting.Boosted.from_json(fitted.to_json())
    assert boosting.predict(again, frame(spark, x, y)).exceptAll(said).count() == 0


def test_balanced_weights_of_folds_and_few_rows(spark, data):
    x, y = data
    df = frame(spark, x, y)
    weighted, names = model.fold_weights(df.selectExpr("*", "IF(id < 30, NULL, CAST(id % 2 AS INT)) AS fold"), "y", 2)
    rows = weighted.collect()
    assert names == ["_weight0", "_weight1", "_weight2"]
    for m, inside in enumerate((lambda i: i >= 30 and i % 2 != 0, lambda i: i >= 30 and i % 2 != 1, lambda i: i >= 30)):
        own = [r for r in rows if inside(r["id"])]
        for r in rows:
            want = len(own) / (len({q["y"] for q in own}) * sum(q["y"] == r["y"] for q in own)) if inside(r["id"]) else None
            assert r[names[m]] == (pytest.approx(want) if want else None)
    none = boosting.fit(df.limit(0).selectExpr("*", "1.0 AS w"), FEATURES, "y", ["w"], 3, 2)[0]
    assert none.trees == [] and boosting.predict(none, df.limit(3)).count() == 3
    nan = df.limit(1).selectExpr("id", "CAST('NaN' AS DOUBLE) AS f0", "f1", "f2", "f3", "y")
    null = df.limit(1).selectExpr("id", "CAST(NULL AS DOUBLE) AS f0", "f1", "f2", "f3", "y")
    fitted = model.fit_boosted(df, FEATURES, "y", 3, rounds=2)
    assert boosting.predict(fitted, nan).first()["probability"] == boosting.predict(fitted, null).first()["probability"]
