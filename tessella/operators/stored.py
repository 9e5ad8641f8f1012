"""Indexes that are written once and read in part: postings in buckets of their terms, vectors in cells around centres.

An index is a folder of batches. A batch counts when its marker, written last, is there; a stopped build leaves no marker, and
the next one begins a new batch. The markers say what was indexed, so that a changed corpus is noticed.
"""

from __future__ import annotations

import json
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.shared import written
from tessella.functions.shipping import by_value

from . import retrieval
from .position import if_small, top

by_value(__name__)

VERSION = 1
#: Centres at most.
CENTRES = 1024
#: Cells that each query reads before it knows which others it must read.
FIRST_CELLS = 3


class StaleIndex(ValueError):
    """What an index was made from isn't what it is asked to serve."""


def _markers(spark: SparkSession, path: str) -> list[dict]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return []
    rows = spark.read.option("recursiveFileLookup", "true").text(f"{path}/commits").collect()  # a line for each batch
    return sorted((json.loads(r["value"]) for r in rows), key=lambda m: m["batch"])


def _commit(spark: SparkSession, path: str, marker: dict) -> None:
    spark.createDataFrame([(json.dumps(marker, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/commits/{marker['batch']}")


def fingerprint(df: DataFrame, *columns: str) -> dict:
    """Rows and an order-free hash of some columns: {"rows", "hash"}."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*columns)), F.lit(0)).alias("x"), F.sum(F.pmod(F.xxhash64(*columns), F.lit(1_000_000_007))).alias("s")).first()
    return {"rows": row["n"], "hash": f"{row['x']}:{row['s'] or 0}"}


def _check(markers: list[dict], path: str, kind: str, expected: dict | None) -> None:
    if not markers:
        raise StaleIndex(f"{path} holds no finished batch")
    if {(m["version"], m["kind"]) for m in markers} != {(VERSION, kind)}:
        raise StaleIndex(f"{path} was written by another version, or as another kind of index")
    if expected is not None and markers[-1]["made_from"] != expected:
        raise StaleIndex(f"{path} was made from another corpus")


# ---------------------------------------------------------------- postings


def _bucket(term: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class TermIndex:
    """Postings (term, key, tf, size) by bucket, within it as texts came (a bucket is read whole), the number of texts with each term, and each batch's texts and words."""

    def __init__(self, spark: SparkSession, path: str, key: str, markers: list[dict]):
        self.spark, self.path, self.key, self.markers = spark, path, key, markers
        self.buckets = markers[0]["buckets"]
        self.n_docs, words = sum(m["rows"] for m in markers), sum(m["words"] for m in markers)
        self.mean_size = round(words / self.n_docs, 9) if words else 1.0

    @classmethod
    def open(cls, spark: SparkSession, path: str, docs: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> TermIndex:
        """The index at path. With docs (all that it should hold) their number and contents are compared with the index's."""
        markers = _markers(spark, path)
        expected = None if docs is None else fingerprint(docs, key, text)
        _check(markers, path, f"terms by {key}", expected)
        return cls(spark, path, key, markers)

    @classmethod
    def add(cls, path: str, docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = 256) -> TermIndex:
        """A batch more, of texts whose keys aren't indexed yet. A key names one text. The first batch says into how many
        buckets (folders) terms are dealt by a hash."""
        spark = docs.sparkSession
        old, batch = _markers(spark, path), uuid.uuid4().hex
        if old:
            _check(old, path, f"terms by {key}", None)
            buckets = old[0]["buckets"]
        post = retrieval.postings(docs, key, text).withColumn("bucket", _bucket("term", buckets))
        post.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/postings/batch={batch}")
        post = spark.read.parquet(f"{path}/postings/batch={batch}")
        post.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df")).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/terms/batch={batch}")
        words = post.agg(F.sum("tf")).first()[0] or 0
        whole = fingerprint(docs, key, text)
        both = whole if not old else _together(old[-1]["made_from"], whole)
        number = max([m["batch_number"] for m in old], default=0) + 1
        marker = {"batch": f"{number:06d}-{batch}", "batch_number": number, "folder": batch, "version": VERSION, "kind": f"terms by {key}", "buckets": buckets, "words": words, "made_from": both, **whole}
        _commit(spark, path, marker)
        return cls(spark, path, key, [*old, marker])

    def _read(self, name: str, buckets: list[int]) -> DataFrame:
        table = self.spark.read.parquet(f"{self.path}/{name}")
        return table.where(F.col("batch").isin([m["folder"] for m in self.markers]) & F.col("bucket").isin(buckets))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """The k best texts of each query (query, term; distinct) by BM25: query, key, score, rank from 0. Only the buckets of the
        queries' terms are read: at most as many numbers as there are buckets come to the driver to say which."""
        buckets = sorted(r[0] for r in queries.select(_bucket("term", self.buckets)).distinct().collect())
        found = self._read("postings", buckets).select("term", self.key, "tf", "size")
        df = self._read("terms", buckets).groupBy("term").agg(F.sum("df").alias("df"))
        return retrieval.bm25(found, self.n_docs, self.mean_size, queries, self.key, k, known=df)


def _together(a: dict, b: dict) -> dict:
    """The fingerprint of two sets of rows from theirs."""
    (x, s), (y, t) = (map(int, f["hash"].split(":")) for f in (a, b))
    return {"rows": a["rows"] + b["rows"], "hash": f"{x ^ y}:{s + t}"}


# ---------------------------------------------------------------- vectors


class VectorIndex:
    """Vectors in cells, each around the centre that is nearest to them, and each cell's centre, radius and number of vectors."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key
        self.cells = spark.read.parquet(f"{path}/cells")
        self.vectors = spark.read.parquet(f"{path}/vectors")

    @classmethod
    def open(cls, spark: SparkSession, path: str, vectors: DataFrame | None = None, key: str = "vec_id", vector: str = "embedding") -> VectorIndex:
        """The index at path. With vectors (all that it should hold) their number and contents are compared with the index's."""
        expected = None if vectors is None else fingerprint(vectors, key, vector)
        _check(_markers(spark, path), path, f"vectors by {key}", expected)
        return cls(spark, path, key)

    @classmethod
    def build(cls, path: str, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> VectorIndex:
        """Centres are at most CENTRES (the square root of the number of vectors, if less) vectors, those least by a hash: so
        many are collected. Null vectors aren't indexed; all others must be of one length."""
        spark = vectors.sparkSession
        rows = vectors.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("vector"))
        whole = fingerprint(vectors, key, vector)
        n = min(CENTRES, max(1, math.isqrt(whole["rows"])))
        least = rows.select("vector").distinct().orderBy(F.xxhash64("vector"), "vector").limit(n)
        centres = np.array([r["vector"] for r in least.collect()], float)

        def place(batches):
            norms = (centres**2).sum(1)
            for batch in batches:
                x = batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1)
                cell = np.argmin(norms - 2 * x @ centres.T, 1) if len(x) else np.zeros(0, int)
                far = np.sqrt(((x - centres[cell]) ** 2).sum(1)) if len(x) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("vector"), pa.array(cell, pa.int32()), pa.array(far, pa.float64())], names=[key, "vector", "cell", "far"])

        placed = rows.mapInArrow(place, f"`{key}` {dict(rows.dtypes)[key]}, vector array<double>, cell int, far double")
        placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/vectors")
        shape = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("rows"))
        known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
        known.join(shape, "cell").coalesce(1).write.parquet(f"{path}/cells")
        _commit(spark, path, {"batch": "000001", "batch_number": 1, "version": VERSION, "kind": f"vectors by {key}", "made_from": whole, **whole})
        return cls(spark, path, key)

    def _read(self, wanted: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """The k best of each query among the cells that it wants (query, cell), and cells beside them; cells that no query wants
        aren't read.

        Cells are dealt to blocks, large ones to several, which tasks multiply by the queries (query, q) that want any of them.
        """
        shape = sorted((r["cell"], r["rows"]) for r in self.cells.join(F.broadcast(wanted.select("cell").distinct()), "cell", "left_semi").select("cell", "rows").collect())  # at most CENTRES
        dealt, block, held = [], 0, 0
        for cell, rows in shape:
            if held and held + rows > retrieval.BLOCK_ROWS:
                block, held = block + 1, 0
            parts = -(-rows // retrieval.BLOCK_ROWS)
            dealt.append((cell, block, parts))
            block, held = block + parts - 1, rows if parts == 1 else retrieval.BLOCK_ROWS
        blocks = F.broadcast(self.spark.createDataFrame(dealt, "cell int, first int, parts int"))
        rows = self.vectors.where(F.col("cell").isin([c for c, _ in shape])).join(blocks, "cell")
        rows = rows.select(self.key, "vector", (F.col("first") + F.pmod(F.xxhash64(self.key), F.col("parts"))).cast("int").alias("block"))
        asked = wanted.join(blocks, "cell").select("query", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("block")).distinct()
        return retrieval.best_in_blocks(rows, asked.join(queries.select("query", "q"), "query"), self.key, k)

    def plan(self, queries: DataFrame) -> DataFrame:
        """query, q, cell, bound, place: the cells of each query (query, q), those first that may hold the largest products. No vector
        x of a cell has more than q centre + |q| radius, since q (x - centre) is at most that."""
        q = queries.select("query", F.col("q").cast("array<double>").alias("q"))
        length = F.sqrt(retrieval.dot(F.col("q"), F.col("q")))
        bounds = q.crossJoin(F.broadcast(self.cells)).withColumn("bound", retrieval.dot(F.col("q"), F.col("centre")) + length * F.col("radius") + 1e-8)
        return top(bounds.select("query", "q", "cell", "bound"), "query", [F.desc("bound"), F.col("cell")], CENTRES).withColumnRenamed("rank", "place")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """The k largest inner products of each query (query, q) with the vectors of other keys: query, key, score, rank from 0.

        Exact, in two rounds: what the most promising cells hold tells how large the k-th product is at least; then every
        cell that may hold as much is read."""
        plan = written(self.plan(queries).drop("q"))
        first = self._read(plan.where(F.col("place") <= FIRST_CELLS), queries, k)
        least = written(first.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least")))
        every = plan.join(if_small(least), "query", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
        return self._read(written(every.select("query", "cell")), queries, k).withColumn("rank", F.col("rank") - 1)

    def share_read(self, queries: DataFrame, k: int) -> float:
        """The share of (query, cell) pairs that search reads."""
        plan = written(self.plan(queries))
        first = self._read(plan.where(F.col("place") <= FIRST_CELLS), queries, k)
        least = first.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
        read = (F.col("place") <= FIRST_CELLS) | F.col("least").isNull() | (F.col("bound") >= F.col("least"))
        return plan.join(least, "query", "left").agg(F.avg(read.cast("double"))).first()[0]
