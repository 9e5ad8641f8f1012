"""What several operators share: Arrow passes over texts, written tables, files for workers, exact ranks, connected components."""

from __future__ import annotations

import os
import pickle
import sys
import tempfile
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def by_value(module: str) -> None:
    """Functions of this module travel to the executors whole, so the library needn't be installed there."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)

#: Rows that an operator's Python code looks at together; Spark bounds the bytes of a batch itself.
TOGETHER = 500


def kept(key: tuple, make):
    """What a Python worker makes once and keeps from task to task, such as a tokenizer, until another is asked for."""
    store = sys.modules["__main__"].__dict__.setdefault("_tessella_kept", {})
    if key not in store:
        store.clear()
        store[key] = make()
    return store[key]


class Sent:
    """A value of bounded size for every task; it travels with its class, like the functions."""

    def __init__(self, spark: SparkSession, value):
        self.raw = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def __call__(self):
        return pickle.loads(self.raw.value)


def _arrow(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    return {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[kind]


def mapped(df: DataFrame, keep: list[str], fields: dict[str, str], start: Callable, most: int = TOGETHER) -> DataFrame:
    """Columns `keep` of df beside those that start() makes, in one pass without a shuffle.

    start() runs once in a task and returns a function from a part of a batch (at most `most` rows) to (places, columns):
    the row of the part that each result row belongs to (None: one for each, in order), and the values of each of
    `fields`. The kept columns stay Arrow, so that whole numbers beside nulls stay what they are.
    """
    types = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"`{c}` {t}" for c, t in fields.items()])
    kinds = [_arrow(t) for t in fields.values()]

    def run(batches):
        make = start()
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                places, columns = make(part)
                own = [part.column(c) for c in keep]
                if places is not None:
                    own = [c.take(pa.array(places, pa.int64())) for c in own]
                made = [pa.array(v, t) for v, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*own, *made], names=[*keep, *fields])

    return df.mapInArrow(run, schema)


def filter_texts(docs: DataFrame, start: Callable) -> DataFrame:
    """Rows of docs whose text passes, all columns untouched. start() runs once in a task and returns texts -> mask."""

    def run(batches):
        keep = start()
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                yield part.filter(pa.array(keep(part.column("text").to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. One of our own is made where it is unset on one machine
    (tests); on a cluster that is an error, since executors couldn't see one another's files."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and read back, so that lost executors don't mean that it is computed again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def one_text_each(rows: DataFrame) -> DataFrame:
    """doc_id, text: for each doc_id the text that is least by its hash; tasks send on one text an id, however often it stands."""
    return rows.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder for files of workers, in the shared one."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return folder


def fill_folder(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Files that no task had anything for are made empty, so that a missing one is an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    there = {f.getPath().getName() for f in fs.listStatus(path(folder))}
    for name in names:
        if name not in there:
            fs.create(path(f"{folder}/{name}")).close()


def _mounted(folder: str) -> str | None:
    u = urlparse(folder)
    return u.path if u.scheme in ("", "file") else None


def write_arrays(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Arrays one after another in a file of the shared folder; a task that runs again writes the same bytes and takes the name last."""
    local = _mounted(folder)
    if local is not None:
        part = f"{local}/.{name}-{uuid.uuid4().hex}"
        with open(part, "wb") as out:
            for x in arrays:
                out.write(np.ascontiguousarray(x).tobytes())
        os.replace(part, f"{local}/{name}")
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        with store.open_output_stream(f"{path}/{name}") as out:
            for x in arrays:
                out.write(np.ascontiguousarray(x).tobytes())


class Files:
    """Files of a shared folder as bytes: memory-mapped, or, from a store that isn't mounted, the `held` bytes read of late."""

    def __init__(self, folder: str, held: int = 256_000_000):
        self.folder, self.held, self.open = folder, held, {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"open": {}}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.open:
            local = _mounted(self.folder)
            if local is None:
                from pyarrow import fs

                store, path = fs.FileSystem.from_uri(self.folder)
                with store.open_input_stream(f"{path}/{name}") as src:
                    found = np.frombuffer(src.read(), np.uint8)
                while self.open and sum(map(len, self.open.values())) + len(found) > self.held:
                    del self.open[next(iter(self.open))]
            else:
                path = f"{local}/{name}"
                found = np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
            self.open[name] = found
        return self.open[name]


def ranked(df: DataFrame, key: str, ties: list[str], name: str = "rank", across: bool = False) -> DataFrame:
    """Adds each row's 0-based rank among the rows with its `key` (across: among all rows, by key first).

    A key with n rows is dealt by a hash of `ties` into about sqrt(n) blocks, so neither a block nor the list of a
    key's blocks is large when one key holds a third of all rows. The blocks' offsets are running sums of their
    counts. Ranks are gapless whatever the ties; rows equal in all of `ties` are interchangeable.
    For keys with a small range (at most thousands of values): their counts are broadcast.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    if across:
        before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    else:
        sizes = sizes.withColumn("_base", F.lit(0).cast("long"))
    sizes = sizes.select(F.col(key).alias("_key"), "_base", F.ceil(F.sqrt("_n")).alias("_blocks"))
    dealt = df.join(F.broadcast(sizes), F.col(key).eqNullSafe(F.col("_key"))).withColumn(
        "_block", F.pmod(F.xxhash64(*ties), F.col("_blocks"))
    )
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy(F.col("_key").alias("_k"), F.col("_block").alias("_b"))
        .agg(F.count(F.lit(1)).alias("_m"))
        .select("_k", "_b", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_offset"))
    )
    inside = F.row_number().over(Window.partitionBy("_key", "_block").orderBy(*ties))
    return (
        dealt.withColumn("_row", inside)
        .join(offsets, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b")))
        .withColumn(name, F.col("_base") + F.col("_offset") + F.col("_row") - 1)
        .drop("_key", "_base", "_blocks", "_block", "_k", "_b", "_offset", "_row")
    )


def components(edges: DataFrame, most: int = 40) -> DataFrame:
    """Connected components of undirected edges (a, b): one row (v, component) for each end, component the least id reached.

    Alternating large-star and small-star rounds: each hangs every vertex on the least vertex around it. A round
    joins and aggregates edges only, which never grow in number beyond vertices plus edges; rounds grow with the
    logarithm of a component's diameter. Raises if `most` rounds don't suffice; never returns half a result.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stash(e, "edges")
    seen = None
    for _ in range(most):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
        star = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = star.where("u <> v").distinct()
        low = star.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        near = star.join(low, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stash(near.unionByName(low.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if now == seen:
            roots = e.select(F.col("v").alias("v"), F.col("v").alias("component")).distinct()
            return e.select(F.col("u").alias("v"), F.col("v").alias("component")).unionByName(roots)
        seen = now
    raise RuntimeError(f"components: not ended after {most} rounds")


def blocks_of(most: int, task: int = 16_000_000) -> F.Column:
    """Into how many blocks a group of `rows` rows and `bytes` bytes is cut that is joined with itself block by block: as many
    as keep a block at about `most` rows and `task` bytes."""
    return F.greatest(F.lit(1), F.ceil(F.col("rows") / most), F.ceil(F.col("bytes") / task)).cast("int")


def tasks_for(groups: float) -> int:
    """Tasks for so many groups that are small in bytes but long in work, which Spark would otherwise put together by bytes."""
    return int(max(1, min(groups, 32_768)))
