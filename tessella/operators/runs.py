"""Runs that go on where they stopped: answers of a model, and the steps of a build.

What a run has is known by files that are whole or not there: a file takes its name when it is complete. A run that is
stopped, or loses a task, asks and builds only what is absent.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.shared import written
from tessella.functions.shipping import by_value

from . import evaluate, forms

by_value(__name__)

#: Prompts that a client gets at once; so many are asked again at most if a task dies before their answers are stored.
TOGETHER = 16
ANSWERS = pa.schema([("hash", pa.string()), ("answer", pa.string()), ("latency_ms", pa.float64())])


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    u = urlparse(folder)
    return (fs.LocalFileSystem(), u.path) if u.scheme in ("", "file") else fs.FileSystem.from_uri(folder)


def _commit_file(folder: str, name: str, rows: pa.Table) -> None:
    """Rows as a Parquet file that has its name only when it is whole."""
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/_{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        pq.write_table(rows, out)
    store.move(part, f"{path}/{name}")


def _stored(folder: str, beginning: str) -> set[str]:
    """The prompts that files with such names answer."""
    store, path = _store(folder)
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    names = [f.path for f in found if f.base_name.startswith(beginning)]
    return {h for n in names for h in pq.read_table(n, columns=["hash"], filesystem=store).column("hash").to_pylist()}


def answers(prompts: DataFrame, key: str, prompt: str, start: Callable[[], Callable[[list[str]], list[str]]], path: str, tag: str) -> DataFrame:
    """(key, answer, latency_ms) of each prompt, from the run `tag` under path; what the run doesn't have yet is asked.

    A prompt is known by its SHA-256, so prompts that are equal are asked once, and changed ones anew. start() makes a client once
    in each task; it gets TOGETHER prompts at once, and its answers are stored before it gets more. A client that raises stops
    the run, whose answers so far stay; run it again to ask the rest. A task that Spark runs again skips what it has stored.
    A null prompt isn't asked and has no answer. Where two attempts answered a prompt, one of the answers counts.
    """
    spark = prompts.sparkSession
    folder = f"{path}/answers/tag={tag}"
    hashed = prompts.select(F.col(key), F.sha2(prompt, 256).alias("hash"), F.col(prompt).alias("_prompt"))
    known = _answered(spark, folder)
    todo = hashed.where(F.col("_prompt").isNotNull()).groupBy("hash").agg(F.first("_prompt").alias("prompt"))
    todo = written(todo.join(known.select("hash"), "hash", "left_anti"))  # fixed, so that an attempt sees what the one before saw
    turn = uuid.uuid4().hex

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        own = f"{turn}-{TaskContext.get().partitionId()}-"
        done = _stored(folder, own) if TaskContext.get().attemptNumber() else set()
        client, number = None, 0
        for batch in batches:
            rest = batch[~batch["hash"].isin(done)]
            for at in range(0, len(rest), TOGETHER):
                part = rest.iloc[at : at + TOGETHER]
                client = client or start()
                began = time.perf_counter()
                said = client(list(part["prompt"]))
                each = (time.perf_counter() - began) * 1000 / len(part)
                rows = pa.table({"hash": list(part["hash"]), "answer": list(said), "latency_ms": [each] * len(part)}, ANSWERS)
                _commit_file(folder, f"{own}{TaskContext.get().taskAttemptId()}-{number}.parquet", rows)
                number += 1
            yield pd.DataFrame({"n": [len(rest)]})

    todo.mapInPandas(ask, "n long").agg(F.sum("n")).first()
    found = _answered(spark, folder)
    return hashed.join(found, "hash", "left").select(key, "answer", "latency_ms")


def _answered(spark: SparkSession, folder: str) -> DataFrame:
    """hash, answer, latency_ms: one answer for each prompt that the run has asked."""
    store, path = _store(folder)
    schema = "hash string, answer string, latency_ms double"
    if not any(f.base_name.endswith(".parquet") and not f.base_name.startswith("_") for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True))):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(folder)
    return rows.groupBy("hash").agg(F.min(F.struct("answer", "latency_ms")).alias("a")).select("hash", "a.*")


def evaluated(prompts: DataFrame, key: str, prompt: str, truth: str, start, path: str, tag: str) -> DataFrame:
    """From prompts with their truth to a stored report: asks what the run doesn't have, reads the answers, and stores records,
    raw answers, metrics and report under path/tag=<tag>. Returns the metrics."""
    said = answers(prompts, key, prompt, start, path, tag)
    read = forms.parsed_answers(said, key, "answer", ["answer", "latency_ms"])
    records = prompts.select(key, F.col(truth).alias("truth")).join(read, key)
    return evaluate.store_run(records, path, tag)


# ---------------------------------------------------------------- steps


@dataclass
class Step:
    """A step of a build: its name, what it is made from (any JSON value, such as a table's fingerprint and parameters), the
    steps it needs, and make(folder, {needed step: its folder}), which fills a folder."""

    name: str
    made_from: object
    make: Callable[[str, dict[str, str]], None]
    needs: tuple[str, ...] = ()


@dataclass
class Status:
    name: str
    folder: str | None
    skipped: bool = False
    ok: bool = True
    seconds: float = 0.0
    message: str = ""


def _marker(path: str, name: str) -> dict | None:
    store, root = _store(f"{path}/{name}")
    if store.get_file_info(f"{root}/done.json").type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(f"{root}/done.json") as src:
        return json.loads(src.read())


def _mark(path: str, name: str, marker: dict) -> None:
    store, root = _store(f"{path}/{name}")
    store.create_dir(root, recursive=True)
    part = f"{root}/_{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(json.dumps(marker, sort_keys=True).encode())
    store.move(part, f"{root}/done.json")


def build(path: str, steps: list[Step], force: tuple[str, ...] = (), skip: tuple[str, ...] = ()) -> list[Status]:
    """Runs steps in their order. A step whose fingerprint (of what it and the steps before it are made from) is that of its
    marker is skipped; else it fills a new folder, and its marker is written last, so what a stopped step left is never read.

    `force` makes steps anew; `skip` leaves steps out, and with them those that need them. A step that fails ends the build
    with its message; what was done stays. Returns a status for each step that was come to.
    """
    prints: dict[str, str] = {}
    folders: dict[str, str] = {}
    out: list[Status] = []
    for step in steps:
        if step.name in skip or any(n not in folders for n in step.needs):
            out.append(Status(step.name, None, skipped=True, message="left out"))
            continue
        whole = json.dumps([step.name, step.made_from, [prints[n] for n in step.needs]], sort_keys=True, default=str)
        prints[step.name] = hashlib.sha256(whole.encode()).hexdigest()
        marker = _marker(path, step.name)
        if marker and marker["fingerprint"] == prints[step.name] and step.name not in force:
            folders[step.name] = marker["folder"]
            out.append(Status(step.name, marker["folder"], skipped=True, message="there already"))
            continue
        began, folder = time.perf_counter(), f"{path}/{step.name}/{uuid.uuid4().hex}"
        if step.name in force:
            prints[step.name] = hashlib.sha256(f"{prints[step.name]}{folder}".encode()).hexdigest()  # those that need it are made anew
        try:
            step.make(folder, dict(folders))
        except Exception as problem:  # told to the caller in the status
            out.append(Status(step.name, None, ok=False, seconds=time.perf_counter() - began, message=f"{type(problem).__name__}: {problem}"))
            return out
        _mark(path, step.name, {"fingerprint": prints[step.name], "folder": folder})
        folders[step.name] = folder
        out.append(Status(step.name, folder, seconds=time.perf_counter() - began, message="made"))
    return out
