"""The five steps from raw tables to all that the operators read: split, statistics, model, term index, guideline graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting, graph, model, position, runs, stored


def steps(cohort: DataFrame, key: str, label: str, features: list[str], texts: DataFrame, text_key: str, text: str, rounds: int = 50, seed: int = 42) -> list[runs.Step]:
    """Steps for runs.build. cohort: a row for each key with features (null: missing) and a label from 0 up; texts: the guideline's
    pages. Each is told by a fingerprint of its rows, so a changed table makes its steps anew, and no other."""
    spark = cohort.sparkSession
    cohort = cohort.select(key, label, *features)
    cohort_print, text_print = stored.fingerprint(cohort, key, label, *features), stored.fingerprint(texts, text_key, text)

    def split(folder: str, _: dict[str, str]) -> None:
        model.stratified_split(cohort, key, label, seed=seed).write.parquet(folder)

    def statistics(folder: str, made: dict[str, str]) -> None:
        train = spark.read.parquet(made["split"]).where("split = 'train'")
        long = train.select(F.col(label).alias("class"), F.explode(F.array(*[F.struct(F.lit(f).alias("measure"), F.col(f).cast("double").alias("value")) for f in features])).alias("m"))
        position.cube(long.select("class", "m.*", F.lit(0).alias("day"))).write.parquet(folder)

    def predictor(folder: str, made: dict[str, str]) -> None:
        rows = spark.read.parquet(made["split"])
        train = rows.where("split = 'train'")
        classes = (train.agg(F.max(label)).first()[0] or 0) + 1
        fitted = model.fit_boosted(train, features, label, classes, rounds)
        held = boosting.predict(fitted, rows.where("split = 'test'"))
        right = held.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
        model.save(fitted, folder, {"features": features, "classes": classes, "holdout_accuracy": right})

    def index(folder: str, _: dict[str, str]) -> None:
        stored.TermIndex.add(folder, texts, text_key, text)

    def guideline(folder: str, _: dict[str, str]) -> None:
        nodes, edges = graph.concept_graph(graph.concept_matches(texts, text_key, text))
        nodes.write.parquet(f"{folder}/nodes")
        edges.write.parquet(f"{folder}/edges")

    return [
        runs.Step("split", [cohort_print, key, label, features, seed], split),
        runs.Step("statistics", features, statistics, ("split",)),
        runs.Step("model", [features, rounds], predictor, ("split",)),
        runs.Step("index", [text_print, text_key, text], index),
        runs.Step("graph", [text_print, text_key, text], guideline),
    ]
