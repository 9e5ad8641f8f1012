"""Prefix trie of conversations: balanced parentheses in each shard, and what shards share is merged."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_value, stash

by_value(__name__)

#: Every conversation is given the first turns of the one that leads its FAMILY.
FAMILY, MOST_GIVEN = 20, 3
#: Parentheses in a shard, about; in a block of the range min-max tree; ids in a piece of a list that is hashed.
SHARD, BLOCK, PIECE = 1 << 19, 512, 4096
WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- balanced parentheses


class Parentheses:
    """Balanced parentheses (1 opens, 0 closes) with the least and the largest excess of each block and a tree of these."""

    def __init__(self, bits: np.ndarray):
        self.bits = np.asarray(bits, np.int8)
        self.excess = np.cumsum(2 * self.bits.astype(np.int64) - 1)
        blocks = max(1, -(-len(bits) // BLOCK))
        self.width = 1 << (blocks - 1).bit_length()
        far = np.iinfo(np.int64).max
        padded = np.full(self.width * BLOCK, far)
        padded[: len(bits)] = self.excess
        self.low = np.full(2 * self.width, far)
        self.low[self.width :] = padded.reshape(-1, BLOCK).min(1)
        padded[len(bits) :] = -far
        self.high = np.full(2 * self.width, -far)
        self.high[self.width :] = padded.reshape(-1, BLOCK).max(1)
        for k in range(self.width - 1, 0, -1):
            self.low[k] = min(self.low[2 * k], self.low[2 * k + 1])
            self.high[k] = max(self.high[2 * k], self.high[2 * k + 1])
        pairs = np.zeros(len(bits) + 1, np.int64)
        if len(bits) > 1:
            pairs[1:-1] = (self.bits[:-1] == 1) & (self.bits[1:] == 0)
        self._pairs = np.cumsum(pairs)

    def pairs(self, at: int) -> int:
        """Rank: how many pairs () begin before the place."""
        return int(self._pairs[at])

    def _within(self, begin: int, end: int, wanted: int) -> int:
        found = np.flatnonzero(self.excess[begin:end] == wanted)
        return begin + int(found[0]) if len(found) else -1

    def findclose(self, at: int) -> int:
        """The place of the parenthesis that closes the one opened at a place: the first where the excess is one less than there."""
        wanted = int(self.excess[at]) - 1
        block = at // BLOCK
        found = self._within(at + 1, (block + 1) * BLOCK, wanted)
        if found >= 0:
            return found
        k = self.width + block
        holds = lambda j: self.low[j] <= wanted <= self.high[j]
        while k % 2 or not holds(k + 1):  # up, until a subtree to the right holds it
            k //= 2
            if k == 0:
                raise ValueError(f"the parenthesis at {at} isn't closed")
        k += 1
        while k < self.width:
            k = 2 * k if holds(2 * k) else 2 * k + 1
        return self._within((k - self.width) * BLOCK, (k - self.width + 1) * BLOCK, wanted)


def shard_sums(paths: list[list[dict]]) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Of a shard's conversations, sorted by path: the nodes' keys (the root first, as 0, 0), the leaves in each node's
    subtree, and the summed worth of the nodes in it. A step of a path has k1, k2, leaf, worth (0 but in one path of all)."""
    bits, keys, leaf, worth = [1], [(0, 0)], [False], [0]
    before: list[dict] = []
    for path in paths:
        same = 0
        while same < min(len(path), len(before)) and (path[same]["k1"], path[same]["k2"]) == keys_of(before[same]):
            path[same]["node"] = before[same]["node"]
            same += 1
        bits += [0] * (len(before) - same)
        for step in path[same:]:
            step["node"] = len(keys)
            bits.append(1)
            keys.append(keys_of(step))
            leaf.append(step["leaf"])
            worth.append(0)
        for step in path:
            worth[step["node"]] += step["worth"]
        before = path
    bits += [0] * (len(before) + 1)
    tree = Parentheses(np.array(bits))
    opened = np.flatnonzero(tree.bits)
    # a pair () whose node goes on in another shard is no leaf
    broken = np.array([tree.bits[p + 1] == 0 and not real for p, real in zip(opened, leaf, strict=True)])
    broken = np.r_[0, np.cumsum(broken)]
    total = np.r_[0, np.cumsum(np.array(worth, object))]
    leaves, saved = [], []
    for node, place in enumerate(opened.tolist()):
        close = tree.findclose(place)
        last = node + (close - place + 1) // 2  # so many nodes are in the subtree
        leaves.append(tree.pairs(close) - tree.pairs(place) - int(broken[last] - broken[node]))
        saved.append(int(total[last] - total[node]))
    return keys, leaves, saved


def keys_of(step: dict) -> tuple[int, int]:
    return step["k1"], step["k2"]


# ---------------------------------------------------------------- running values within a key of any size


def running(df: DataFrame, key: str, order: list[Column], made: dict[str, tuple[Column, Callable, Callable]]) -> DataFrame:
    """df with running aggregates within a key: name -> (column, aggregate, function that joins two aggregates).

    Rows are sorted into ranges of (key, order), so a key that holds a third of all rows has many ranges; each goes on
    from what the ranges before it carry over. At most a row for each range is broadcast.
    """
    kept = stash(df.repartitionByRange(F.col(key), *order).withColumn("_part", F.spark_partition_id()), "ranges")
    ends = kept.groupBy(key, "_part").agg(*[f(c).alias(f"_{n}") for n, (c, f, _) in made.items()])
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy(key).orderBy("_part")) == 1
    carried = ends.select(F.col(key).alias("_key"), F.col("_part").alias("_own"), first.alias("_first"), *[f(f"_{n}").over(before).alias(f"_{n}") for n, (_, f, _) in made.items()])
    carried = stash(carried.where("NOT _first").drop("_first"), "carried")
    inside = Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = kept.withColumns({n: f(c).over(inside) for n, (c, f, _) in made.items()}).join(F.broadcast(carried), (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_own")), "left")
    joined = {n: F.when(F.col(f"_{n}").isNull(), F.col(n)).when(F.col(n).isNull(), F.col(f"_{n}")).otherwise(join(F.col(n), F.col(f"_{n}"))) for n, (_, _, join) in made.items()}
    return out.withColumns(joined).drop("_part", "_key", "_own", *[f"_{n}" for n in made])


def _add(a: Column, b: Column) -> Column:
    return a + b


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


# ---------------------------------------------------------------- from conversations to nodes


def numbered(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 1, by turn, null first), t1 and t2 (128 bits of the turn's SHA-256), words. Rows of no conversation go."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(" "), role, text), 256)
    part = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", part(1).alias("t1"), part(17).alias("t2"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("tie"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2"), F.col("tie")]
    return running(turns, "conv", order, {"pos": (F.lit(1).cast("long"), F.sum, _add)}).drop("turn", "tie")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows conv, d, total, t1, t2, words of the rebuilt conversations; conv, total of all of them, turnless ones too)."""
    sizes = stash(turns.groupBy("conv").agg(F.max("pos").alias("n")), "sizes")
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % (MOST_GIVEN + 1)).cast("long")
    leads = sizes.select(F.col("conv").alias("_lead"), F.col("n").alias("_given"))
    plan = sizes.select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % FAMILY).alias("lead")).join(leads, F.col("lead") == F.col("_lead"), "left")
    given = F.least("h", F.coalesce("_given", F.lit(0)))
    plan = plan.select("conv", "h", "lead", given.alias("given"), (given + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"))
    own = turns.join(plan.drop("lead"), "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("given")).alias("d"), "total", "t1", "t2", "words")
    first = turns.where(F.col("pos") <= MOST_GIVEN).withColumnRenamed("conv", "_conv")
    first = plan.join(first, (F.col("lead") == F.col("_conv")) & (F.col("pos") <= F.col("given"))).select("conv", F.col("pos").alias("d"), "total", "t1", "t2", "words")
    return own.unionByName(first), plan.select("conv", "total")


def ends_hashes(ends: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256: the hash of the ids of each key's conversations, ascending. Ranges of ids are joined into pieces, wherever
    they are; the task that hashes a key's pieces holds one batch of them."""

    def joined(batches):
        for batch in batches:
            k1, k2, ids = (batch.column(c).to_numpy() for c in ("k1", "k2", "conv"))
            begins = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
            cuts = [i for b, e in zip(begins, np.r_[begins[1:], len(ids)], strict=True) for i in range(b, e, PIECE)]
            text = [",".join(map(str, ids[b:e].tolist())) for b, e in zip(cuts, [*cuts[1:], len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[cuts]) for x in (k1, k2, ids)), pa.array(text, pa.string())], names=["k1", "k2", "first", "ids"])

    def hashed(batches):
        key, digest, out = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["k1"], row["k2"]) != key:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (row["k1"], row["k2"]), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(row["ids"].encode())
            yield _keyed(out, pa.string(), "ends_sha256")
            out = []
        if key is not None:
            yield _keyed([(*key, digest.hexdigest())], pa.string(), "ends_sha256")

    order = ["k1", "k2", "conv"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined, "k1 long, k2 long, first long, ids string")
    return pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(hashed, "k1 long, k2 long, ends_sha256 string")


def _keyed(rows: list[tuple], kind: pa.DataType, *names: str) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[kind] * len(names)]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["k1", "k2", *names])


def subtree_sums(paths: DataFrame, shard: int = SHARD) -> DataFrame:
    """k1, k2, leaves, saved of the nodes on the paths (column path: their steps); see shard_sums.

    Paths are sorted into ranges, and a range is cut into shards of about so many parentheses. A node on paths of several
    shards (the spine between neighbours, and the root) has its sums in each of them, which are added.
    """

    def encoded(batches):
        held, size = [], 0

        def sums():
            keys, leaves, saved = shard_sums(held)
            return _keyed([(*k, a, b) for k, a, b in zip(keys, leaves, saved, strict=True)], pa.int64(), "leaves", "saved")

        for batch in batches:
            for path in batch.column("path").to_pylist():
                held.append(path)
                size += 2 * len(path) + 1
                if size >= shard:
                    yield sums()
                    held, size = [], 0
        if held:
            yield sums()

    ordered = paths.withColumn("_order", F.transform("path", lambda x: F.struct(x["k1"], x["k2"])))
    ordered = ordered.repartitionByRange("_order").sortWithinPartitions("_order").select("path")
    parts = ordered.mapInArrow(encoded, "k1 long, k2 long, leaves long, saved long")
    return parts.groupBy("k1", "k2").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def trie(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is known by 128 bits made of the hashes of its turns and their places. Equal conversations count once, with
    their number, and nodes that all conversations of their parent pass are one step of a path, so a path has no more steps
    than there are conversations that part from it: those of a table of N turns, about the root of 2 N at most. Only these
    paths are ever gathered; a conversation's turns are not, however many it has.

    Rows with a null conv_id belong to no conversation. Null turns come first; turns that are equal, or both null, are
    ordered by a hash of role and text. A null role or text is empty; repeated rows are turns of their own. conv_id must be a
    whole number, and c % 20 has the sign of c. An empty table has no root and gives an empty result; a table whose
    conversations are all turnless gives the root alone, a leaf. Other columns are not looked at.
    """
    turns = stash(numbered(conversations.select("conv_id", "turn", "role", "text")), "turns")
    rows, convs = rebuilt(turns)
    convs = stash(convs, "convs")
    for k, (name, seed) in enumerate((("h1", 1), ("h2", 2))):
        rows = rows.withColumn(name, F.xxhash64(F.lit(seed + k), "d", "t1", "t2"))
    xor = lambda c: (F.col(c), F.bit_xor, _xor)
    rows = running(rows.drop("t1", "t2"), "conv", [F.col("d")], {"k1": xor("h1"), "k2": xor("h2"), "read": (F.col("words"), F.sum, _add)})
    parents = {f"p{i}": F.col(f"k{i}").bitwiseXOR(F.col(f"h{i}")) for i in (1, 2)}
    rows = stash(rows.withColumns(parents).drop("h1", "h2"), "prefixes")

    zero = F.lit(0).cast("long")
    ends = rows.where("d = total").select("conv", "k1", "k2").unionByName(convs.where("total = 0").select("conv", zero.alias("k1"), zero.alias("k2")))
    ends = stash(ends, "ends")
    reps = stash(ends.groupBy("k1", "k2").agg(F.min("conv").alias("rep"), F.count(F.lit(1)).alias("weight")), "reps")
    members = rows.join(reps.select("rep", "weight"), F.col("conv") == F.col("rep")).drop("rep", "total")
    nodes = members.groupBy("k1", "k2").agg(
        F.min("conv").alias("owner"), F.min("d").alias("d"), F.sum("weight").alias("n_convs"), F.count(F.lit(1)).alias("texts"),
        F.min("words").alias("words"), F.min("read").alias("read"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
    )
    nodes = stash(nodes, "nodes")

    everyone = convs.agg(F.min("conv").alias("least"), F.count(F.lit(1)).alias("n")).first()
    below = nodes.groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("n_children")).select(F.col("p1").alias("c1"), F.col("p2").alias("c2"), "n_children")
    deep = nodes.where("d > 1").join(nodes.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("owner").alias("parent"), F.col("n_convs").alias("around")), (F.col("p1") == F.col("q1")) & (F.col("p2") == F.col("q2")))
    top = nodes.where("d = 1").withColumns({"parent": F.lit(everyone["least"]).cast("long"), "around": F.lit(-1).cast("long")})
    named = deep.drop("q1", "q2").unionByName(top).join(below, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left").drop("c1", "c2", "p1", "p2")
    named = named.withColumn("begins", F.col("n_convs") != F.col("around")).drop("around")
    named = stash(running(named, "owner", [F.col("d")], {"step": (F.when(F.col("begins"), F.col("d")), F.max, F.greatest)}), "named")

    words = named.groupBy(F.col("owner").alias("o"), F.col("step").alias("s")).agg(F.sum("words").alias("words_of_step"))
    steps = named.where("begins").join(words, (F.col("owner") == F.col("o")) & (F.col("d") == F.col("s"))).select(
        "k1", "k2", "owner", "step", (F.col("texts") == 1).alias("leaf"), ((F.col("n_convs") - 1) * F.col("words_of_step")).alias("worth"), (F.col("read") - F.col("words")).alias("read_before")
    )
    steps = stash(steps, "steps")
    walked = members.select("conv", "d", "k1", "k2").join(steps.select("k1", "k2", "owner", "leaf", "worth"), ["k1", "k2"])
    walked = walked.select("conv", F.struct("d", "k1", "k2", "leaf", F.when(F.col("conv") == F.col("owner"), F.col("worth")).otherwise(0).alias("worth")).alias("step"))
    gathered = walked.groupBy("conv").agg(F.array_sort(F.collect_list("step")).alias("path"))
    turnless = reps.where("k1 = 0 AND k2 = 0").select(F.col("rep").alias("conv"), F.array().cast(dict(gathered.dtypes)["path"]).alias("path"))
    sums = stash(subtree_sums(stash(gathered.unionByName(turnless), "paths"), shard), "sums")
    hashes = stash(ends_hashes(ends), "hashes")

    of_step = steps.join(sums, ["k1", "k2"]).select(F.col("owner").alias("o"), F.col("step").alias("s"), "read_before", "n_leaves", "saved_tokens")
    out = named.join(of_step, (F.col("owner") == F.col("o")) & (F.col("step") == F.col("s"))).join(hashes, ["k1", "k2"], "left")
    passed = (F.col("n_convs") - 1) * (F.col("read") - F.col("words") - F.col("read_before"))  # of the step, above the node
    inner = out.select(
        F.col("owner").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", zero).alias("n_children"),
        "n_leaves", (F.col("saved_tokens") - passed).alias("saved_tokens"), "ends_sha256",
    )
    root = sums.where("k1 = 0 AND k2 = 0").join(hashes, ["k1", "k2"], "left").join(below.where("c1 = 0 AND c2 = 0"), (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left").select(
        F.lit(everyone["least"]).cast("long").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(everyone["n"]).cast("long").alias("n_convs"),
        F.coalesce("n_children", zero).alias("n_children"), F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens", "ends_sha256",
    )
    return inner.unionByName(root).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
