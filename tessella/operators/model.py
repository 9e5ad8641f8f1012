"""Splits, folds and models: boosted trees for tables, pyspark.ml for texts."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, NGram, RegexTokenizer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.shared import written

from . import boosting
from .evaluate import agreement, over_folds, ovr_auc
from .position import if_small


def _place(df: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """Rank of each row within its class in the order of a hash, with the class's size.

    Rows are ranked within (class, first hexadecimal digits of the hash): offsets of these blocks come from their
    counts, so a class with most of the rows is ranked in 256 tasks.
    """
    hashed = df.withColumn("_h", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))).withColumn("_b", F.substring("_h", 1, 2))
    w = Window.partitionBy(label).orderBy("_b")
    counts = hashed.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_m"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = counts.withColumn("_n", F.sum("_m").over(Window.partitionBy(label))).withColumnRenamed(label, "_l").withColumnRenamed("_b", "_c")
    inside = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key))
    joined = hashed.withColumn("_i", inside).join(counts, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_c")))
    return joined.withColumn("_row", F.col("_before") + F.col("_i")).drop("_h", "_b", "_m", "_before", "_l", "_c", "_i")


def stratified_split(df: DataFrame, key: str, label: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds split: of each class the first round(test * size) rows in hash order are test, the others train."""
    placed = _place(df, key, label, seed)
    return placed.withColumn("split", F.when(F.col("_row") <= F.round(F.col("_n") * test), "test").otherwise("train")).drop("_row", "_n")


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold, 0 to folds - 1: the rows of each class in turn, so that its folds differ by one row at most."""
    return _place(df, key, label, seed).withColumn("fold", ((F.col("_row") - 1) % folds).cast("int")).drop("_row", "_n")


def usable_folds(df: DataFrame, label: str, folds: int) -> int:
    """No more folds than the smallest class has rows, and at least 2."""
    least = df.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    return max(2, min(folds, least))


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds weight: n / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    weights = counts.crossJoin(F.broadcast(total)).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return df.join(if_small(weights), label)


def fit_boosted(train: DataFrame, features: list[str], label: str, classes: int, rounds: int = 50) -> boosting.Boosted:
    """Boosted trees with balanced class weights; missing features stay missing. Labels are 0 to classes - 1."""
    return boosting.fit(balanced_weights(train, label), features, label, ["weight"], classes, rounds)[0]


def fold_weights(df: DataFrame, label: str, folds: int) -> tuple[DataFrame, list[str]]:
    """Adds a balanced weight for the rows outside each fold (column fold; null: the holdout) and one for all folds' rows; null elsewhere.

    The counts of a class in each fold are what is broadcast: a row for each class.
    """
    seen = [F.col("fold") != k for k in range(folds)] + [F.col("fold").isNotNull()]
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("_l")).agg(*[F.count_if(c).alias(f"_n{m}") for m, c in enumerate(seen)])
    totals = counts.agg(*[f(F.col(f"_n{m}")).alias(f"_{n}{m}") for m in range(len(seen)) for n, f in (("all", F.sum), ("k", lambda c: F.count_if(c > 0)))])
    held = df.join(counts, F.col(label) == F.col("_l"), "left").crossJoin(F.broadcast(totals))
    names = [f"_weight{m}" for m in range(len(seen))]
    weights = {w: F.when(c, F.col(f"_all{m}") / (F.col(f"_k{m}") * F.nullif(F.col(f"_n{m}"), F.lit(0)))) for m, (w, c) in enumerate(zip(names, seen, strict=True))}
    return held.withColumns(weights).select(*df.columns, *names), names


def train_and_evaluate(df: DataFrame, key: str, label: str, features: list[str], folds: int = 3, rounds: int = 50) -> DataFrame:
    """Rows (part, accuracy, macro_f1, ..., auc) of each fold of the training part and of the holdout. The models of the folds
    and of the whole training part are fitted in the same jobs. Labels are 0 and up."""
    split = written(stratified_split(written(df), key, label))
    classes = [r[0] for r in split.groupBy(label).count().orderBy(label).collect() if r[0] is not None]  # a row for each class
    train = split.where("split = 'train'")
    n = usable_folds(train, label, folds)
    dealt = stratified_folds(train, key, label, n).unionByName(split.where("split = 'test'").withColumn("fold", F.lit(None).cast("int")))
    weighted, names = fold_weights(dealt, label, n)
    weighted = written(weighted)
    models = boosting.fit(weighted, features, label, names, max(classes, default=0) + 1, rounds)
    out = None
    for k, model in enumerate(models):
        held = weighted.where("fold IS NULL" if k == n else f"fold = {k}")
        scored = written(boosting.predict(model, boosting.spread(held)))
        row = agreement(scored.select((F.col(label) + 1).alias("truth"), (F.col("predicted") + 1).alias("predicted"))).withColumn("part", F.lit("holdout" if k == n else f"fold {k}"))
        row = row.crossJoin(F.broadcast(ovr_auc(scored, label, "probability", tuple(range(max(classes, default=0) + 1)))))
        out = row if out is None else out.unionByName(row)
    return out


def fold_summary(rows: DataFrame) -> DataFrame:
    """Mean and population deviation over the folds of train_and_evaluate: one row."""
    return over_folds(rows.where(F.col("part").startswith("fold")), ["accuracy", "macro_f1", "auc"])


def top_features(df: DataFrame, features: list[str], label: str, k: int = 10, rounds: int = 50) -> DataFrame:
    """(place, feature, importance) of the k features whose cuts gain most in trees boosted on all rows."""
    classes = (df.agg(F.max(label)).first()[0] or 0) + 1
    found = boosting.importance(fit_boosted(df, features, label, classes, rounds), k)
    return df.sparkSession.createDataFrame([(i, f, v) for i, (f, v) in enumerate(found)], "place int, feature string, importance double")


def train_with_imputation(obs: DataFrame, labels: DataFrame, label: str, measures: list[str], days: list[int], strategy: str | None = "linear_noise", folds: int = 3, rounds: int = 50) -> DataFrame:
    """From observations to metrics: fills gaps, forms a value, mask and delta column for each measure and day, boosted
    trees, their folds and holdout. labels: (patient, label)."""
    from . import series

    done = series.with_missingness(obs.where(F.col("day").isin(days)), measures, strategy)
    at = lambda c, m, d: F.max(F.when((F.col("measure") == m) & (F.col("day") == d), F.col(c))).cast("double")
    cells = {f"{m}N{d}{s}": at(c, m, d) for m in measures for d in days for c, s in (("value", ""), ("mask", "_mask"), ("delta", "_tdelta"))}
    wide = done.groupBy("patient").agg(*[v.alias(k) for k, v in cells.items()])
    return train_and_evaluate(wide.join(labels, "patient"), "patient", label, list(cells), folds, rounds)


def text_classifier(text: str, label: str, features: int = 1 << 14) -> Pipeline:
    """Words and pairs of words, tf-idf, logistic regression."""
    words = RegexTokenizer(inputCol=text, outputCol="w1", pattern=r"[^\p{L}\p{N}_]+")
    return Pipeline(
        stages=[
            words,
            NGram(n=2, inputCol="w1", outputCol="w2"),
            HashingTF(inputCol="w1", outputCol="t1", numFeatures=features),
            HashingTF(inputCol="w2", outputCol="t2", numFeatures=features),
            VectorAssembler(inputCols=["t1", "t2"], outputCol="tf"),
            IDF(inputCol="tf", outputCol="features"),
            LogisticRegression(labelCol=label, maxIter=20),
        ]
    )


def save(model: PipelineModel | boosting.Boosted, path: str, meta: dict) -> None:
    """A fitted pipeline, or boosted trees as a line of JSON, with what it was trained on beside it."""
    spark = SparkSession.active()
    line = lambda text, to: spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{to}")
    if isinstance(model, boosting.Boosted):
        line(model.to_json(), "model")
    else:
        model.write().overwrite().save(f"{path}/model")
    line(json.dumps({"kind": type(model).__name__, "meta": meta}, ensure_ascii=False, sort_keys=True), "meta")


def load(path: str) -> tuple[PipelineModel | boosting.Boosted, dict]:
    spark = SparkSession.active()
    said = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    if said["kind"] == "Boosted":
        return boosting.Boosted.from_json(spark.read.text(f"{path}/model").first()["value"]), said["meta"]
    return PipelineModel.load(f"{path}/model"), said["meta"]
