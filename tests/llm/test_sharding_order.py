"""Shards follow a plain Hilbert sort, and files can be skipped by any of its dimensions."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import sharding


def coordinates(values, bins):
    """The number of bins begun up to each value: value v is in bin floor(bins * rows below v / all rows), nulls are below all."""
    have = sorted(v for v in values if v is not None)
    below, seen = {}, len(values) - len(have)
    for v in have:
        below.setdefault(v, seen)
        seen += 1
    begins = {}
    for v in sorted(below):
        begins.setdefault(below[v] * bins // len(values), v)
    bounds = [v for b, v in begins.items() if b > 0]
    return [0 if v is None else sum(b <= v for b in bounds) for v in values]


@pytest.fixture(scope="module")
def sharded(spark, tiny):
    docs = spark.read.parquet(f"{tiny.replace('sf0.001', 'sf0.01')}/documents.parquet")
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 17 != 0, F.col("lang"))).unionByName(docs.limit(40))
    rows = sharding.document_shards(docs, 40).select("doc_id", "lang", "source", "size", "cell", "shard", "slot").collect()
    assert len(rows) == docs.count()
    return rows


def test_shards_follow_a_plain_hilbert_sort(sharded):
    side = 1 << sharding.BITS
    places = list(zip(*(coordinates([r[d] for r in sharded], side) for d in ("lang", "source", "size")), strict=True))
    cells = [sharding.hilbert_index(p, sharding.BITS) for p in places]
    assert [r["cell"] for r in sharded] == cells and len(set(cells)) > 20
    n = len(sharded)
    order = sorted(range(n), key=lambda i: (sharded[i]["shard"], sharded[i]["slot"]))
    assert [cells[i] for i in order] == sorted(cells)
    assert [sharded[i]["shard"] for i in order] == [rank * 40 // n for rank in range(n)]


def read_share(rows, shard_of, wanted):
    """The share of shards whose least and largest values don't rule out rows that a filter (dimension, low, high) wants."""
    ends = collections.defaultdict(list)
    for r, s in zip(rows, shard_of, strict=True):
        ends[s].append(r)
    keep = 0
    for own in ends.values():
        keep += all(any(r[d] is not None for r in own) and min(r[d] for r in own if r[d] is not None) <= high and max(r[d] for r in own if r[d] is not None) >= low for d, low, high in wanted)
    return keep / len(ends)


def test_files_are_skipped_by_each_dimension(sharded):
    sizes = sorted(r["size"] for r in sharded)
    n, shards = len(sharded), [r["shard"] for r in sharded]
    other = np.random.default_rng(0).permutation(shards).tolist()
    small = ("size", sizes[0], sizes[n // 10])
    for d in ("lang", "source"):
        values = sorted({r[d] for r in sharded if r[d]})
        alone = np.mean([read_share(sharded, shards, [(d, v, v)]) for v in values])
        both = np.mean([read_share(sharded, shards, [(d, v, v), small]) for v in values])
        assert np.mean([read_share(sharded, other, [(d, v, v)]) for v in values]) > 0.95
        assert alone < 0.9 and both < 0.4, (d, alone, both)
    assert read_share(sharded, other, [small]) > 0.95
    assert read_share(sharded, shards, [small]) < 0.5
