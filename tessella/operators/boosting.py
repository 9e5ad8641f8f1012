"""Gradient-boosted trees for any number of classes: one aggregate over (node, feature, bin) for each level of a round's trees.

Rows stay where they are: a level sums gradients and hessians by node, feature and bin with partial aggregates, windows over the
sums find the best cut of each node, and only that cut comes to the driver. Several models, such as those of folds, are trained in
the same jobs. Rows are dealt to tasks by their number, since they are few bytes and much work. Missing values have a bin of their own and go to whichever side gains more.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.shared import written

TREE = "struct<feature:array<int>,cut:array<double>,left:array<boolean>,value:array<double>>"
#: Hessians of a side, at least.
LEAST_HESSIAN = 1e-3
#: Rows of a task, about. Rows are short and a level makes one of each for every model, class and feature, so bytes tell little of the work.
TASK_ROWS = 4096


@dataclass
class Boosted:
    """A fitted model: the features by place, the start of each class's score, the trees of each round by class, gains by feature.

    A tree's nodes are numbered from 0, those below node i are 2 i + 1 (left: values up to the cut) and 2 i + 2; the feature of a
    leaf is -1.
    """

    features: list[str]
    start: list[float]
    depth: int
    trees: list[list[dict]] = field(default_factory=list)
    gains: list[float] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def from_json(cls, text: str) -> Boosted:
        return cls(**json.loads(text))


def _values(features: list[str]) -> Column:
    """The features as doubles; NaN is missing."""
    numbers = [F.col(f).cast("double") for f in features]
    return F.array(*[F.when(~F.isnan(c), c) for c in numbers])


def _leaf(values: Column, tree: Column, depth: int) -> Column:
    """The node where a row's values end."""

    def step(node: Column, _: Column) -> Column:
        value = F.get(values, F.get(tree["feature"], node))
        left = F.coalesce(value <= F.get(tree["cut"], node), F.get(tree["left"], node))
        return F.when(F.get(tree["feature"], node) < 0, node).otherwise(2 * node + F.when(left, 1).otherwise(2)).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step) if depth else F.lit(0)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: what a lambda refers to is computed anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _softmax(scores: Column) -> Column:
    raised = lambda own: _bound(F.array_max(own), lambda top: F.transform(own, lambda s: F.exp(s - top)))
    share = lambda r: _bound(F.aggregate(r, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(r, lambda e: e / total))
    return _bound(scores, lambda own: _bound(raised(own), share))


def spread(rows: DataFrame) -> DataFrame:
    """The rows of a written table over tasks of about TASK_ROWS each, however few bytes they take."""
    return rows.repartition(max(1, -(-rows.count() // TASK_ROWS)))


def _one_row(spark: SparkSession, schema: str, *values) -> DataFrame:
    """A table of one row to be broadcast: as large as the model."""
    return F.broadcast(spark.createDataFrame([values], schema))


def _constant(value, schema: str) -> Column:
    """A value that a plan carries along, such as one round's trees."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def bin_edges(rows: DataFrame, features: int, bins: int) -> list[list[float]]:
    """For each place of the arrays `values` the distinct quantiles at 1 / bins, 2 / bins, ..., which end its bins; missing values don't count."""
    shares = [i / bins for i in range(1, bins)]
    row = rows.agg(*[F.percentile_approx(F.get("values", F.lit(i)), shares, 10_000).alias(f"q{i}") for i in range(features)]).first()
    return [sorted(set(q or [])) for q in row]


def histogram(state: DataFrame, trees: Column, models: int, classes: int, level: int) -> DataFrame:
    """model, class, node, feature, bin (-1: missing), g, h, n: sums over the rows in the nodes of a level.

    state: values, bins, weights (of each model), grads (of each model and class: g, h); trees: those being grown."""
    one = lambda m, k: F.struct(
        m.alias("model"), k.alias("class"), _leaf(F.col("values"), F.get(F.get("trees", m), k), level).alias("node"), F.get(F.get("grads", m), k).alias("grad"), (F.get("weights", m) > 0).alias("in")
    )
    each = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(models - 1)), lambda m: F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: one(m, k))))
    rows = state.withColumn("trees", trees).select("bins", F.explode(each).alias("e")).where(F.col("e.in") & (F.col("e.node") >= (1 << level) - 1))
    rows = rows.select("e.model", "e.class", "e.node", "e.grad.g", "e.grad.h", F.posexplode("bins").alias("feature", "bin"))
    return rows.groupBy("model", "class", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n"))


def best_cuts(sums: DataFrame, ridge: float, least_rows: int) -> DataFrame:
    """For each (model, class, node) with an allowed cut the best one: gain, feature, bin (the last on the left), missing_left, and
    g, h of the left side and of all; ties go to the first feature, the first bin, and missing values to the right."""
    node = ["model", "class", "node"]
    up_to = Window.partitionBy(*node, "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*node, "feature")
    told = sums.withColumns({f"{c}_{p}": F.sum(x).over(w) for c in ("g", "h", "n") for p, x, w in (
        ("all", F.col(c), whole), ("gone", F.when(F.col("bin") < 0, F.col(c)).otherwise(0), whole), ("cum", F.when(F.col("bin") >= 0, F.col(c)).otherwise(0), up_to))})
    sides = told.where("bin >= 0").withColumn("missing_left", F.explode(F.array(F.lit(False), F.lit(True))))
    sides = sides.withColumns({f"{c}_left": F.col(f"{c}_cum") + F.when(F.col("missing_left"), F.col(f"{c}_gone")).otherwise(0) for c in ("g", "h", "n")})
    right = {c: F.col(f"{c}_all") - F.col(f"{c}_left") for c in ("g", "h", "n")}
    worth = lambda g, h: g * g / (h + ridge)
    gain = worth(F.col("g_left"), F.col("h_left")) + worth(right["g"], right["h"]) - worth(F.col("g_all"), F.col("h_all"))
    allowed = (F.least("n_left", right["n"]) >= least_rows) & (F.least("h_left", right["h"]) >= LEAST_HESSIAN)
    order = F.struct(F.round(gain, 9).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), (~F.col("missing_left")).alias("r"))
    best = F.max_by(F.struct(gain.alias("gain"), "feature", "bin", "missing_left", "g_left", "h_left", "g_all", "h_all"), order)
    return sides.where(allowed).groupBy(*node).agg(best.alias("best")).select(*node, "best.*").where("gain > 1e-9")


def started(df: DataFrame, features: list[str], label: str, weights: list[str], classes: int, edges: list[list[float]] | None = None, bins: int = 32, depth: int = 4) -> tuple[DataFrame, list[list[float]], list[Boosted]]:
    """(y, values, bins, weights, scores of the rows with a label, written; the bins' edges; the models before their first tree).

    A class's score begins as the logarithm of its share of the weights."""
    spark, models = df.sparkSession, len(weights)
    rows = df.where(F.col(label).isNotNull()).select(
        F.col(label).cast("int").alias("y"), _values(features).alias("values"), F.array(*[F.coalesce(F.col(w).cast("double"), F.lit(0.0)) for w in weights]).alias("weights")
    )
    rows = written(rows)
    edges = bin_edges(rows, len(features), bins) if edges is None else edges
    bin_of = F.zip_with("values", "edges", lambda x, e: F.when(x.isNull(), -1).otherwise(F.size(F.filter(e, lambda v: v < x))))
    state = written(spread(rows).crossJoin(_one_row(spark, "edges array<array<double>>", edges)).select("y", "values", bin_of.alias("bins"), "weights"))
    counts = state.groupBy("y").agg(*[F.sum(F.get("weights", F.lit(m))).alias(f"w{m}") for m in range(models)]).collect()  # a row for each class
    out = []
    for m in range(models):
        share = [sum(r[f"w{m}"] for r in counts if r["y"] == k) for k in range(classes)]
        start = [math.log(max(s, 1e-12) / max(sum(share), 1e-12)) for s in share]
        out.append(Boosted(list(features), start, depth, [], [0.0] * len(features)))
    return state.withColumn("scores", F.array(*[F.array(*[F.lit(s) for s in b.start]) for b in out])), edges, out


def with_grads(state: DataFrame, classes: int) -> DataFrame:
    """Adds grads: for each model and class the weighted gradient g of the cross entropy and its hessian h, times n / (n - 1) for n classes."""
    factor = classes / max(1, classes - 1)
    of = lambda p, m: F.transform(p, lambda q, k: F.struct(
        (F.get("weights", m) * (q - F.when(F.col("y") == k, 1.0).otherwise(0.0))).alias("g"), (F.get("weights", m) * factor * q * (1 - q)).alias("h")))
    return state.withColumn("grads", F.transform(F.transform("scores", _softmax), of))


def fit(
    df: DataFrame, features: list[str], label: str, weights: list[str], classes: int, rounds: int = 50, depth: int = 4, bins: int = 32,
    rate: float = 0.1, ridge: float = 1.0, least_rows: int = 5, edges: list[list[float]] | None = None,
) -> list[Boosted]:
    """A model for each column of `weights`: rows with a positive weight are those it is fitted on. Labels are 0 to classes - 1.

    Rows without a label are left out. The driver holds the bins' edges and the trees; a round reads the rows once a level and
    writes their gradients once.
    """
    models = len(weights)
    state, edges, out = started(df, features, label, weights, classes, edges, bins, depth)
    size = (1 << (depth + 1)) - 1
    for _ in range(rounds):
        state = written(with_grads(state, classes))
        grown = [[{"feature": [-1] * size, "cut": [0.0] * size, "left": [False] * size, "value": [0.0] * size} for _ in range(classes)] for _ in range(models)]
        for level in range(depth):
            trees = _constant(grown, f"array<array<{TREE}>>")
            cuts = best_cuts(histogram(state, trees, models, classes, level), ridge, least_rows).collect()  # a row for each node of a level
            for c in cuts:
                tree, node, ends = grown[c["model"]][c["class"]], c["node"], edges[c["feature"]]
                below = 2 * node + 1
                tree["feature"][node], tree["left"][node] = c["feature"], c["missing_left"]
                tree["cut"][node] = ends[c["bin"]] if c["bin"] < len(ends) else math.inf  # missing values against all others
                tree["value"][below] = -rate * c["g_left"] / (c["h_left"] + ridge)
                tree["value"][below + 1] = -rate * (c["g_all"] - c["g_left"]) / (c["h_all"] - c["h_left"] + ridge)
                out[c["model"]].gains[c["feature"]] += c["gain"]
            if not cuts:
                break
        if all(t["feature"][0] < 0 for trees in grown for t in trees):
            break
        for m in range(models):
            out[m].trees.append(grown[m])
        tree = lambda m, k: F.get(F.get("trees", m), k)
        moved = F.transform("scores", lambda s, m: F.transform(s, lambda x, k: x + F.get(tree(m, k)["value"], _leaf(F.col("values"), tree(m, k), depth))))
        state = state.withColumn("trees", _constant(grown, f"array<array<{TREE}>>")).withColumn("scores", moved).drop("trees", "grads")
    return out


def predict(model: Boosted, df: DataFrame) -> DataFrame:
    """Adds predicted (the likeliest class, the first of equal ones) and probability (an array)."""
    spark = df.sparkSession
    trees = _one_row(spark, f"_start array<double>, _trees array<array<{TREE}>>", model.start, model.trees)
    values = _values(model.features)
    score = F.transform("_start", lambda s, k: F.aggregate("_trees", s, lambda a, t: a + F.get(F.get(t, k)["value"], _leaf(F.col("_values"), F.get(t, k), model.depth))))
    out = df.withColumn("_values", values).crossJoin(trees).withColumn("probability", _softmax(score)).drop("_values", "_start", "_trees")
    return out.withColumn("predicted", (F.array_position("probability", F.array_max("probability")) - 1).cast("int"))


def importance(model: Boosted, k: int) -> list[tuple[str, float]]:
    """The k features whose cuts gained most, with their summed gains."""
    return sorted(zip(model.features, model.gains, strict=True), key=lambda p: (-p[1], p[0]))[:k]
