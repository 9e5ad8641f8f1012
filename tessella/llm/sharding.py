"""Sharding along a Hilbert curve: quantise metadata dimensions, order by curve index, cut equal runs. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ranked, stash

BITS = 4


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Place of a grid point on the Hilbert curve through a cube with sides of 2**bits (Skilling's transform)."""
    x = list(point)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(len(x)):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t, q = 0, top
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    out = 0
    for b in reversed(range(bits)):
        for v in x:
            out = out << 1 | v >> b & 1
    return out


def curve_table(dims: int, bits: int) -> list[int]:
    """Curve index of each cell, by the cell's row-major number."""
    side = 1 << bits
    return [hilbert_index(tuple(c >> bits * (dims - 1 - d) & side - 1 for d in range(dims)), bits) for c in range(side**dims)]


def quantile_bounds(df: DataFrame, dims: list[str], bins: int, blocks: int = 256) -> dict[str, list]:
    """For each dimension the values at which its bins begin: value v is in bin floor(bins * rows below v / all rows).

    Exact for numbers and strings alike: rows are counted by value, values are ranked in ranges cut at a few of them
    (those least by a hash), and the ranges' offsets are running sums, so that no task holds all values of a dimension.
    Only the bounds come to the driver. Nulls are below all values.
    """
    out = {}
    for d in dims:
        v = F.col("v")
        counts = stash(df.groupBy(F.col(d).alias("v")).agg(F.count(F.lit(1)).alias("n")), "value-counts")
        cuts = [r["v"] for r in counts.where(v.isNotNull()).orderBy(F.xxhash64("v"), "v").limit(blocks).collect()]
        at = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(cuts)]), lambda c: c <= v)) if cuts else F.lit(0)
        dealt = counts.withColumn("block", F.when(v.isNull(), -1).otherwise(at))
        before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        total = Window.partitionBy()
        offsets = dealt.groupBy("block").agg(F.sum("n").alias("m"))
        offsets = offsets.select("block", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset"), F.sum("m").over(total).alias("all"))
        inside = Window.partitionBy("block").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
        below = F.col("offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))
        placed = dealt.join(F.broadcast(offsets), "block").withColumn("bin", F.floor(below * bins / F.col("all")))
        first = placed.where(v.isNotNull()).groupBy("bin").agg(F.min("v").alias("v"))
        out[d] = [r["v"] for r in first.where("bin > 0").collect()]
    return out


def hilbert_shards(df: DataFrame, dims: list[str], shards: int, ties: list[str], bits: int = BITS) -> DataFrame:
    """Adds cell (curve index), shard (0 to shards - 1) and slot (0-based place in the shard).

    Each dimension is cut into 2**bits bins at its own quantiles (equal values share a bin, so that one may hold more
    than its part), a cell's place comes from the Hilbert curve, and row number r of n in that order goes to shard
    floor(r * shards / n): counts differ by one at most. Rows of a cell lie in the order of a hash of `ties`, so a cell
    with a third of all rows is ranked in many tasks. Nulls count below all values. An empty table gives an empty
    result; repeated rows get places of their own; other columns pass through.
    df is read several times: pass a narrow, written table.
    """
    if bits * len(dims) > 15:
        raise ValueError("the grid may have 2**15 cells at most")
    side = 1 << bits
    bounds, n = quantile_bounds(df, dims, side), df.count()
    cell = F.lit(0)
    for d in dims:
        cell = cell * side + sum(((F.coalesce(F.col(d) >= F.lit(b), F.lit(False))).cast("int") for b in bounds[d]), F.lit(0))
    places = F.expr(f"array({','.join(map(str, curve_table(len(dims), bits)))})")
    placed = df.withColumn("cell", F.element_at(places, cell + 1))
    placed = ranked(placed, "cell", ties, "_rank", across=True)
    shard = F.expr(f"_rank * {shards} div {max(n, 1)}")
    return (
        placed.withColumn("shard", shard.cast("int"))
        .withColumn("slot", F.col("_rank") - F.expr(f"(shard * {n}L + {shards - 1}) div {shards}"))
        .drop("_rank")
    )


def document_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """documents by lang, source and size; null texts have no bytes. See hilbert_shards for nulls, ties and empty tables."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        "lang",
        "source",
    )
    narrow = stash(narrow, "shard-keys")
    return hilbert_shards(narrow, ["lang", "source", "size"], shards, ["doc_id", "text_crc32", "size"])


def write_shards(rows: DataFrame, path: str) -> None:
    """The shards as Parquet folders shard=N, each in curve order; file statistics then allow skipping by every dimension."""
    (
        rows.repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
