"""Triage of many patients by a model behind a function; the answers are read with Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.shipping import by_value

from .forms import parsed_answers

by_value(__name__)


def asked(prompts: DataFrame, key: str, prompt: str, start: Callable[[], Callable[[list[str]], list[str]]]) -> DataFrame:
    """(key, answer, latency_ms). start() makes a client once in each task; it gets the prompts of a batch at once.

    A client that raises fails its task, which Spark runs again: errors aren't swallowed.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        client = start()
        for batch in batches:
            began = time.perf_counter()
            answers = client(list(batch[prompt]))
            each = (time.perf_counter() - began) * 1000 / max(len(batch), 1)
            yield pd.DataFrame({key: batch[key], "answer": answers, "latency_ms": each})

    return prompts.select(key, prompt).mapInPandas(run, f"{key} {dict(prompts.dtypes)[key]}, answer string, latency_ms double")


def triaged(prompts: DataFrame, key: str, prompt: str, start) -> DataFrame:
    """(key, predicted, confidence, reasoning, answer, latency_ms) of each prompt, which the client is asked once."""
    return parsed_answers(asked(prompts, key, prompt, start), key, "answer", ["answer", "latency_ms"])


def guarded(questions: DataFrame, text: str, patterns: list[str], refusal: str) -> DataFrame:
    """Adds reply: the refusal where a pattern matches, else null."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col(text).rlike(p)
    return questions.withColumn("reply", F.when(hit, F.lit(refusal)))
