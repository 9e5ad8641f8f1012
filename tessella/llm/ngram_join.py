"""Jaccard join of word shingles by chosen paths: sets are split again and again on tokens that they sample alike."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks_of, by_value, components, kept, mapped, stash, tasks_for
from .embedding_dedup import spanning

by_value(__name__)

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Paths that a pair at the threshold goes on to share from a node of the tree, on average (at least): over 1, or it would be
#: lost on the way down. A set samples SHARED / threshold of its tokens at a node.
SHARED = 1.6
#: Buckets of up to so many sets are compared pair by pair.
SMALL = 32
#: Least hashes in a sketch, of two bits each.
SKETCH = 64
#: The tree ends here: what is still large is compared whole. Buckets whose sets are unlike shrink from level to level, by
#: SHARED / threshold times the share of tokens that two of their sets have in common, so few come this far.
DEEPEST = 8
#: Up to so many sets are looked up by a broadcast of some 100 bytes each; more by a join that shuffles the texts.
LOOKED_UP = 500_000
#: Sets compared at once in a block of a dense bucket; sets of one home have blocks of their own there if they are more than OWN.
BLOCK, OWN = 2048, 512
_G = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def shingles(text: str | None, hashes: WordHashes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words, in lower case; of all words if there are fewer; none of an empty text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.array(list(map(hashes.__getitem__, words)), np.uint64)
    k = min(width, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = mix((h ^ w[i : len(w) - k + 1 + i]) * _G)
    return np.unique(h)


def dies_out(mean: float = SHARED) -> float:
    """The chance that what a pair shares below a node comes to an end, of a tree that branches by Poisson's law."""
    q = 0.0
    for _ in range(200):
        q = math.exp(mean * (q - 1))
    return q


def runs_for(recall: float) -> int:
    """Repetitions after which a pair at the threshold shares a bucket at every depth with the wanted chance.

    Sets x and y choose a token of both with chance branch / max(|x|, |y|), so they share branch * |x & y| / max(|x|, |y|)
    of them at a node on average, which is at least SHARED. In all runs together the paths that lead on for ever number
    runs * SHARED * (1 - dies_out) on average, and none is there with the chance exp(-that).
    """
    return math.ceil(-math.log(1 - recall) / (SHARED * (1 - dies_out())))


def differ_for(threshold: float, lost: float = 1e-8) -> int:
    """Codes of a sketch in which a pair at the threshold differs at most, but for the chance `lost`. Codes differ with the
    chance 3/4 * (1 - threshold) each."""
    p, tail, k = 0.75 * (1 - threshold), 0.0, SKETCH
    while k > 0 and tail + (now := math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)) <= lost:
        tail, k = tail + now, k - 1
    return k


_FACTORS = mix(np.arange(1, SKETCH + 1, dtype=np.uint64) * _G) | np.uint64(1)


def choose(tokens: np.ndarray, nodes: np.ndarray, branch: float) -> tuple[np.ndarray, np.ndarray]:
    """(place of the node, path) through the tokens sampled at each node: those whose hash with it is small for the set's size."""
    share = branch / max(len(tokens), 1)
    if share >= 1:
        at, token = np.divmod(np.arange(len(nodes) * len(tokens)), max(len(tokens), 1))
    else:
        at, token = np.nonzero(mix(tokens[None, :] ^ mix(nodes)[:, None]) < np.uint64(int(share * 2.0**64)))
    return at, mix(tokens[token] * _G + nodes[at])


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Two bits of each of SKETCH least hashes, in two numbers."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(tokens), 1024):
        np.minimum(least, (tokens[None, i : i + 1024] * _FACTORS[:, None]).min(1), out=least)
    bits = least >> np.uint64(17) & np.uint64(3)
    return np.bitwise_or.reduce((bits << np.arange(0, 2 * SKETCH, 2, dtype=np.uint64) % np.uint64(64)).reshape(-1, 32), axis=1).view(np.int64)


def _key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _paths(width: int, runs: int, branch: float) -> Callable:
    """Each set's key and size, its paths of length one (in all runs), those of length two with the place of the first, and its sketch."""
    roots = np.arange(1, runs + 1, dtype=np.uint64)

    def start():
        hashes = kept(("shingle words",), WordHashes)

        def make(part: pa.RecordBatch):
            rows = []
            for text in part.column("text").to_pylist():
                s = shingles(text, hashes, width)
                if not len(s):
                    rows.append((None,) * 7)
                    continue
                paths = np.unique(choose(s, roots, branch)[1])
                at, kids = choose(s, paths, branch)
                rows.append((_key(s), len(s), paths.view(np.int64), at.astype(np.int32), kids.view(np.int64), *sketch(s).tolist()))
            return None, list(zip(*rows, strict=True)) or [[]] * 7

        return make

    return start


def _sets(width: int) -> Callable:
    """Tokens of the texts whose set has the key; another text with the same mark goes."""

    def start():
        hashes = kept(("shingle words",), WordHashes)

        def make(part: pa.RecordBatch):
            places, found = [], []
            for i, (key, text) in enumerate(zip(part.column("key").to_pylist(), part.column("text").to_pylist(), strict=True)):
                s = shingles(text, hashes, width)
                if _key(s) == key:
                    places.append(i)
                    found.append(s.tobytes())
            return places, [found]

        return make

    return start


def _children(branch: float) -> Callable:
    """The paths below given nodes of each set."""

    def start():
        def make(part: pa.RecordBatch):
            places, found = [], []
            for i, (nodes, tokens) in enumerate(zip(part.column("nodes").to_pylist(), part.column("tokens").to_pylist(), strict=True)):
                kids = np.unique(choose(np.frombuffer(tokens, np.uint64), np.array(nodes, np.int64).view(np.uint64), branch)[1])
                places += [i] * len(kids)
                found.append(kids.view(np.int64))
            return places, [np.concatenate(found) if found else []]

        return make

    return start


def shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set of a shares with each of b."""
    common = np.intersect1d(np.concatenate(a), np.concatenate(b))
    out = np.zeros((len(a), len(b)), np.float32)
    flat = []
    for sets in (a, b):
        t = np.concatenate(sets)
        place = np.minimum(np.searchsorted(common, t), max(len(common) - 1, 0))
        met = common[place] == t if len(common) else np.zeros(len(t), bool)
        flat.append((np.repeat(np.arange(len(sets)), [len(s) for s in sets])[met], place[met]))
    for lo in range(0, len(common), 4096):
        m = []
        for (row, col), sets in zip(flat, (a, b), strict=True):
            x = np.zeros((len(sets), min(4096, len(common) - lo)), np.float32)
            use = (col >= lo) & (col < lo + 4096)
            x[row[use], col[use] - lo] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out


def alike(inter: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Jaccard >= threshold, in whole numbers of millionths so that ties count."""
    t = round(threshold * 1e6)
    inter = inter.astype(np.int64)
    return 1_000_000 * inter >= t * (na[:, None] + nb[None, :] - inter)


def _dense(threshold: float):
    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        """Links between two blocks of a dense bucket. A pair that shares several buckets is counted in that with the least path:
        sets are told apart by their lesser paths first, so those that share one with every other set aren't compared here."""
        path, first, second = key
        left = group[group["block"] == first].sort_values("rep")
        right = left if first == second else group[group["block"] == second].sort_values("rep")
        rows: list = []
        if len(left) and len(right):
            lesser = [[tuple(sorted(p for p in paths if p < path)) for paths in side["parts"]] for side in (left, right)]
            kinds = {k: i for i, k in enumerate({k for side in lesser for k in side})}
            number = {p: i for i, p in enumerate({p for k in kinds for p in k})}
            marks = np.zeros((len(kinds), len(number) + 1), np.float32)
            for k, i in kinds.items():
                marks[i, [number[p] for p in k]] = 1
            apart = marks @ marks.T == 0
            kind = [np.array([kinds[k] for k in side]) for side in lesser]
            there = [np.isin(np.arange(len(kinds)), k) for k in kind]
            left, right = left[apart[:, there[1]].any(1)[kind[0]]], right[apart[:, there[0]].any(1)[kind[1]]]
            kind = [k[apart[:, t].any(1)[k]] for k, t in zip(kind, there[::-1], strict=True)]
        if len(left) and len(right):
            sets = [[np.frombuffer(t, np.uint64) for t in side["tokens"]] for side in (left, right)]
            size = [np.array([len(s) for s in side]) for side in sets]
            match = alike(shared(*sets), *size, threshold) & apart[kind[0]][:, kind[1]]
            if first == second:
                np.fill_diagonal(match, False)
            ids, others = left["rep"].to_numpy(), right["rep"].to_numpy()
            rows = [(r, int(w), int(n), None) for r, w, n in zip(ids, match @ right["size"].to_numpy(), match.sum(1), strict=True) if n]
            if first != second:
                rows += [(r, int(w), int(n), None) for r, w, n in zip(others, left["size"].to_numpy() @ match, match.sum(0), strict=True) if n]
            rows += [(ids[i], 0, 0, others[j]) for i, j in spanning(match)]
        return pd.DataFrame(rows, columns=["rep", "docs", "texts", "other"]).astype({"other": "Int64"})

    return compare


def _verify(threshold: float):
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for a, b in zip(batch["ta"], batch["tb"], strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                inter = np.array([[len(np.intersect1d(x, y, assume_unique=True))]])
                keep.append(bool(alike(inter, np.array([len(x)]), np.array([len(y)]), threshold)[0, 0]))
            yield batch[keep][["a", "b", "size_a", "size_b"]]

    return check


class _Join:
    """One join: the distinct sets, numbered, and the tables that the steps share."""

    def __init__(self, docs: DataFrame, threshold: float, width: int, recall: float):
        self.threshold, self.width, self.branch = threshold, width, SHARED / threshold
        #: Two sets of such similarity go on to share one path from a node on average; if a bucket's are more alike, splitting it doesn't shrink it.
        self.alike = (o := 1 / self.branch) / (2 - o)
        self.narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
        fields = {"key": "binary", "n": "int", "paths": "array<long>", "at": "array<int>", "kids": "array<long>", "s0": "long", "s1": "long"}
        self.sets = stash(mapped(self.narrow, ["doc_id", "mark"], fields, _paths(width, runs_for(recall), self.branch)), "sets")
        one = F.first(F.struct("n", "paths", "at", "kids", "s0", "s1")).alias("one")  # alike in all rows of a key
        where = F.min(F.struct(F.isnull("doc_id").alias("no"), "doc_id", "mark")).alias("where")
        reps = self.sets.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size"), where, one)
        reps = reps.select(F.monotonically_increasing_id().alias("rep"), "key", "least", "size", "where", "one.*")
        self.reps = stash(reps, "set-reps")  # the numbers hold from here on, since only the written table is read

    def buckets(self) -> tuple[DataFrame, DataFrame]:
        """Memberships (path, rep) of small buckets, and of dense ones."""
        level, small, dense, tokens = self.reps.select("rep", F.explode("paths").alias("path")), [], [], None
        for depth in range(1, DEEPEST + 1):
            few, large = _by_size(level)
            small.append(few)
            thick, sparse = self._by_likeness(large) if depth < DEEPEST else (large, None)
            dense.append(thick)
            if sparse is None or sparse.isEmpty():
                break
            if depth == 1:
                level = self._second(sparse)
            else:
                tokens = self.tokens(sparse.select("rep").distinct()) if tokens is None else tokens
                nodes = sparse.groupBy("rep").agg(F.collect_set("path").alias("nodes"))
                level = mapped(nodes.join(tokens, "rep"), ["rep"], {"path": "long"}, _children(self.branch))
        return reduce(DataFrame.unionByName, small), reduce(DataFrame.unionByName, dense)

    def _second(self, sparse: DataFrame) -> DataFrame:
        nodes = stash(sparse.select(F.col("path").alias("node")).distinct(), "nodes")
        kids = self.reps.select("rep", "paths", F.explode(F.arrays_zip("at", "kids")).alias("k"))
        kids = kids.select("rep", F.get("paths", F.col("k.at")).alias("parent"), F.col("k.kids").alias("path"))
        nodes = F.broadcast(nodes) if nodes.count() <= LOOKED_UP else nodes
        return kids.join(nodes, F.col("parent") == F.col("node")).select("rep", "path")

    def _by_likeness(self, large: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Memberships of large buckets whose sets are alike on average, by the sketches of four of them against all, and of the others."""
        rows = large.join(self.reps.select("rep", "s0", "s1"), "rep")
        probes = rows.groupBy("path").agg(*[F.min(F.struct(F.xxhash64("rep", F.lit(k)).alias("h"), "s0", "s1")).alias(f"p{k}") for k in range(4)])
        apart = reduce(lambda a, b: a + b, [differing(F.col("s0"), F.col("s1"), F.col(f"p{k}.s0"), F.col(f"p{k}.s1")) for k in range(4)])
        told = rows.join(probes, "path").groupBy("path").agg((F.avg(apart) / (4 * SKETCH)).alias("apart"))
        told = stash(told.select(F.col("path").alias("told"), (1 - F.col("apart") / 0.75 >= self.alike).alias("thick")), "likeness")
        split = stash(large.join(told, F.col("path") == F.col("told")).select("path", "rep", "thick"), "large")
        return split.where("thick").select("path", "rep"), split.where("not thick").select("path", "rep")

    def tokens(self, wanted: DataFrame) -> DataFrame:
        """(rep, tokens) of some sets, from a text of each: looked up by its document and hash, held against the set's key."""
        wanted = stash(wanted, "wanted")
        found = self.reps.join(wanted, "rep", "left_semi").select("rep", "key", F.col("where.doc_id").alias("_d"), F.col("where.mark").alias("_m"))
        found = F.broadcast(found) if wanted.count() <= LOOKED_UP else found
        rows = self.narrow.join(found, (F.col("mark") == F.col("_m")) & F.col("doc_id").eqNullSafe(F.col("_d"))).select("rep", "key", "text")
        got = stash(mapped(rows, ["rep"], {"tokens": "binary"}, _sets(self.width)), "tokens")
        twice = not got.groupBy("rep").count().where("count > 1").isEmpty()  # a row that stands twice
        return stash(got.groupBy("rep").agg(F.first("tokens").alias("tokens")), "tokens") if twice else got


def jaccard_links(docs: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE, recall: float = RECALL) -> DataFrame:
    """One row for each document: doc_id, class_id (least doc_id of its group), n_links (documents linked directly),
    n_texts (different texts linked), kept (doc_id = class_id).

    Documents with equal shingle sets are one set with a size. In each run a set samples tokens by hashes that all sets
    share; sets that sampled the same token meet in a bucket. Buckets of at most SMALL sets are compared pair by pair
    (sizes, then sketches, then the sets themselves); larger ones are split again on tokens sampled afresh, until they
    are small. Buckets whose sets are so much alike that splitting can't part them (groups of near copies) are compared
    whole, in blocks that return counts and spanning links. Every link is verified on the whole sets; a pair at the
    threshold is missed with a chance of about 1 - recall.

    Null and empty texts have no shingles and link with nothing, not even with one another. Rows that repeat are linked
    like copies; a doc_id that stands twice has a row for each text. A null doc_id counts in no least one and is kept.
    An empty table gives an empty result.
    """
    join = _Join(docs, threshold, width, recall)
    reps = join.reps
    small, dense = join.buckets()
    parts = stash(dense.groupBy("rep").agg(F.collect_set("path").alias("parts")), "parts")
    pairs = stash(_small_pairs(small, reps.select("rep", "n", "s0", "s1"), parts, threshold), "pairs")
    tokens = join.tokens(pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).unionByName(parts.select("rep")).distinct())
    weight = reps.select("rep", "size")
    links = _dense_links(parts, tokens, weight, threshold)
    found = (
        pairs.join(weight.select(F.col("rep").alias("a"), F.col("size").alias("size_a")), "a")
        .join(weight.select(F.col("rep").alias("b"), F.col("size").alias("size_b")), "b")
        .join(tokens.select(F.col("rep").alias("a"), F.col("tokens").alias("ta")), "a")
        .join(tokens.select(F.col("rep").alias("b"), F.col("tokens").alias("tb")), "b")
        .select("a", "b", "size_a", "size_b", "ta", "tb")
        .mapInPandas(_verify(threshold), "a long, b long, size_a long, size_b long")
    )
    found = stash(found, "found")
    one = F.lit(1).cast("long")
    counts = found.select(F.col("a").alias("rep"), F.col("size_b").alias("docs"), one.alias("texts")).unionByName(
        found.select(F.col("b").alias("rep"), F.col("size_a").alias("docs"), one.alias("texts"))
    )
    counts = counts.unionByName(links.select("rep", "docs", "texts"))
    edges = found.select("a", "b").unionByName(links.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    counts = counts.groupBy("rep").agg(F.sum("docs").alias("docs"), F.sum("texts").alias("texts")).withColumnRenamed("rep", "_r")
    roots = stash(components(edges).join(reps.select(F.col("rep").alias("v"), "least"), "v"), "roots")
    roots = roots.join(roots.groupBy("component").agg(F.min("least").alias("class_id")), "component").select("v", "class_id")
    of_set = (
        reps.join(counts, F.col("rep") == F.col("_r"), "left")
        .join(roots, F.col("rep") == F.col("v"), "left")
        .select(
            "key",
            (F.coalesce("docs", F.lit(0)) + F.col("size") - 1).alias("n_links"),
            F.coalesce("texts", F.lit(0)).alias("n_texts"),
            F.coalesce("class_id", "least").alias("class_id"),
        )
    )
    zero, least = F.lit(0).cast("long"), F.coalesce("class_id", "doc_id")
    return join.sets.select("doc_id", "key").join(of_set, "key", "left").select(
        "doc_id",
        least.alias("class_id"),
        F.coalesce("n_links", zero).alias("n_links"),
        F.coalesce("n_texts", zero).alias("n_texts"),
        F.coalesce(F.col("doc_id") == least, F.lit(True)).alias("kept"),
    )


def _by_size(level: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (path, rep) of buckets with 2 to SMALL sets, and of larger ones; a set alone in its bucket goes."""
    sizes = level.groupBy("path").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    met = stash(level.join(sizes, "path").select("path", "rep", "c"), "buckets")
    return met.where(F.col("c") <= SMALL).select("path", "rep"), met.where(F.col("c") > SMALL).select("path", "rep")


def differing(s0: F.Column, s1: F.Column, t0: F.Column, t1: F.Column) -> F.Column:
    """Codes in which two sketches differ."""
    even, out = F.lit(0x5555555555555555), F.lit(0)
    for a, b in ((s0, t0), (s1, t1)):
        x = a.bitwiseXOR(b)
        out = out + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(even))
    return out


def _small_pairs(small: DataFrame, light: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a < b) of small buckets whose sizes and sketches allow the threshold, without those that dense buckets count."""
    rows = small.join(light.join(parts, "rep", "left"), "rep")
    other = rows.select("path", *[F.col(c).alias(f"{c}_") for c in rows.columns if c != "path"])
    near = differing(F.col("s0"), F.col("s1"), F.col("s0_"), F.col("s1_")) <= differ_for(threshold)
    fits = (F.least("n", "n_") >= F.greatest("n", "n_") * (threshold - 1e-9)) & near
    apart = ~F.coalesce(F.arrays_overlap("parts", "parts_"), F.lit(False))
    return rows.join(other, "path").where((F.col("rep") < F.col("rep_")) & fits & apart).select(F.col("rep").alias("a"), F.col("rep_").alias("b")).distinct()


def _dense_links(parts: DataFrame, tokens: DataFrame, weight: DataFrame, threshold: float) -> DataFrame:
    """Counts and spanning links of the dense buckets. parts: all dense buckets of each set.

    A set's home is the least of its buckets. Sets with one home meet there, and needn't in another bucket that they
    share; so of a group of near copies, which share most of their buckets, all but one bucket compare only those few
    that are at home elsewhere. A bucket is cut into blocks: sets of a home with many sets there have blocks of their
    own, and all others mixed ones; two blocks are compared unless both are of one home that isn't the bucket itself.
    """
    sizes = tokens.select("rep", F.octet_length("tokens").alias("b"))
    member = parts.select("rep", "parts", F.array_min("parts").alias("home"), F.explode("parts").alias("path"))
    shape = member.join(sizes, "rep").groupBy("path", "home").agg(F.count(F.lit(1)).alias("rows"), F.sum("b").alias("bytes"))
    shape = shape.withColumn("own", F.when(F.col("rows") > OWN, F.col("home")))  # null: mixed
    shape = shape.groupBy("path", "own").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    before = Window.partitionBy("path").orderBy("own").rowsBetween(Window.unboundedPreceding, -1)
    shape = shape.withColumn("blocks", blocks_of(BLOCK)).withColumn("start", F.coalesce(F.sum("blocks").over(before), F.lit(0)).cast("int"))
    shape = shape.withColumn("all", F.sum("blocks").over(Window.partitionBy("path")).cast("int"))
    shape = stash(shape.where((F.col("own").isNull()) | (F.col("own") == F.col("path")) | (F.col("all") > F.col("blocks"))), "shape")
    homes = shape.where("own is not null").select("path", F.col("own").alias("home"), F.lit(True).alias("large"), "blocks", "start", "all")
    mixed = shape.where("own is null").select("path", F.col("blocks").alias("m_blocks"), F.col("start").alias("m_start"), F.col("all").alias("m_all"))
    small = member.join(_large_homes(member), ["path", "home"], "left_anti").join(mixed, "path")
    dealt = small.select("path", "rep", "parts", "home", F.col("m_blocks").alias("blocks"), F.col("m_start").alias("start"), F.col("m_all").alias("all"), F.lit(False).alias("alone"))
    own = member.join(homes, ["path", "home"]).select("path", "rep", "parts", "home", "blocks", "start", "all", (F.col("home") != F.col("path")).alias("alone"))
    dealt = dealt.unionByName(own).withColumn("block", (F.col("start") + F.pmod(F.xxhash64("rep"), F.col("blocks"))).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("all") - 1), lambda k: ~F.col("alone") | (k < F.col("start")) | (k >= F.col("start") + F.col("blocks")))
    paired = dealt.withColumn("with", F.explode(others)).select("path", F.least("block", "with").alias("first"), F.greatest("block", "with").alias("second"), "block", "rep", "parts")
    groups = shape.select("path", "all").distinct().agg(F.sum(F.col("all") * (F.col("all") + 1) / 2)).first()[0] or 1
    full = paired.join(tokens.select("rep", "tokens"), "rep").join(weight, "rep").repartition(tasks_for(groups), "path", "first", "second")
    found = full.groupBy("path", "first", "second").applyInPandas(_dense(threshold), "rep long, docs long, texts long, other long")
    return stash(found, "dense-links")


def _large_homes(member: DataFrame) -> DataFrame:
    return member.groupBy("path", "home").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > OWN).select("path", "home")


def one_of_each(docs: DataFrame, links: DataFrame) -> DataFrame:
    """documents without those that are kept out: of each group the one with the least doc_id stays, and all without a doc_id.

    Rows that share a doc_id are one document: they stay if one of them does. Null and empty texts stay; columns are untouched.
    """
    gone = links.where("doc_id is not null").groupBy(F.col("doc_id").alias("_gone")).agg(F.bool_or("kept").alias("_kept")).where("not _kept")
    return docs.join(gone.select("_gone"), docs["doc_id"] == gone["_gone"], "left_anti")
