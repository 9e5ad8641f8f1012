"""Approximate nearest neighbours: a robust-pruned directed graph in each shard, searched with a beam."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Files, by_value, fill_folder, mapped, new_folder, stash, tasks_for, write_arrays

by_value(__name__)

#: Edges of a vector, width of a beam (building and searching), and how much farther a kept neighbour may be (see robust_prune).
DEGREE, BEAM, SLACK = 40, 64, 1.2
#: Vectors of a shard at most and at least, and bytes of its vectors at most; between, there are two shards for each core.
SHARD, LEAST_SHARD, SHARD_BYTES = 65_536, 4096, 96_000_000
#: Queries in a block, and vectors that are searched, pruned and linked at once.
QUERIES, TOGETHER = 2048, 256


# ---------------------------------------------------------------- the graph of one shard


def _near(points: np.ndarray, norms: np.ndarray, who: np.ndarray, q: np.ndarray, qn: np.ndarray) -> np.ndarray:
    """Squared distances from query i to points who[i]."""
    return norms[who] - 2 * np.matmul(points[who], q[:, :, None])[:, :, 0] + qn[:, None]


def beam_search(points: np.ndarray, norms: np.ndarray, links: np.ndarray, start: int, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, squared distances) of the `width` nearest points that a greedy search from `start` meets, nearest first, for
    many queries at once. Each step follows the links of the nearest point in the beam not followed yet; a search ends when
    all of its beam has been followed. Places without a point are -1, at an infinite distance."""
    m, n, degree = len(queries), len(points), links.shape[1]
    qn = np.einsum("ij,ij->i", queries, queries)
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True  # where -1 points
    seen[:, start] = True
    who = np.full((m, width), -1)
    far = np.full((m, width), np.inf, points.dtype)
    followed = np.ones((m, width), bool)
    who[:, 0], followed[:, 0] = start, False
    far[:, 0] = _near(points, norms, who[:, :1], queries, qn)[:, 0]
    active = np.arange(m)
    while len(active):
        at = np.argmin(followed[active], 1)  # the first not followed: beams are sorted
        open_ = ~followed[active, at]
        active, at = active[open_], at[open_]
        if not len(active):
            break
        followed[active, at] = True
        around = links[who[active, at]]
        fresh = ~seen[active[:, None], around]
        seen[active[:, None], around] = True
        d = np.where(fresh, _near(points, norms, around, queries[active], qn[active]), np.inf)
        all_d = np.concatenate([far[active], d], 1)
        best = np.argpartition(all_d, width - 1, 1)[:, :width]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(all_d, best, 1), 1, kind="stable"), 1)
        far[active] = np.take_along_axis(all_d, best, 1)
        all_who = np.concatenate([who[active], around], 1)
        who[active] = np.where(np.isfinite(far[active]), np.take_along_axis(all_who, best, 1), -1)
        all_f = np.concatenate([followed[active], np.zeros((len(active), degree), bool)], 1)
        followed[active] = np.take_along_axis(all_f, best, 1) | ~np.isfinite(far[active])
    return who, far


def robust_prune(points: np.ndarray, norms: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, slack: float) -> np.ndarray:
    """For each point own[i], up to `degree` of its candidates (-1: none): the nearest stays, and every candidate goes to which
    a kept one is nearer, by the factor `slack`, than the point itself; then the nearest of the rest, and so on."""
    m, c = candidates.shape
    order = np.sort(candidates, 1)
    again = np.zeros((m, c), bool)
    again[:, 1:] = order[:, 1:] == order[:, :-1]
    order[again | (order == own[:, None])] = -1
    held = points[order]
    d = np.where(order < 0, np.inf, _near(points, norms, order, points[own], norms[own]))
    between = norms[order][:, :, None] + norms[order][:, None, :] - 2 * np.matmul(held, held.transpose(0, 2, 1))
    out = np.full((m, degree), -1)
    rows = np.arange(m)
    left = d.copy()
    for k in range(degree):
        best = left.argmin(1)
        there = np.isfinite(left[rows, best])
        if not there.any():
            break
        out[there, k] = order[rows, best][there]
        left[slack * slack * between[rows, best] < d] = np.inf
        left[rows, best] = np.inf
    return out


def scaled(vectors: np.ndarray, like: np.ndarray) -> np.ndarray:
    """The vectors in single precision, in units of the middle one's largest entry in `like`, within bounds that squares keep."""
    with np.errstate(over="ignore"):
        return np.clip(vectors / np.median(np.abs(like).max(1)), -1e15, 1e15).astype(np.float32)


def build(vectors: np.ndarray, degree: int = DEGREE, width: int = BEAM, slack: float = SLACK) -> tuple[np.ndarray, int]:
    """(links, start) of a graph over the vectors: links[i] are the places of up to `degree` neighbours, -1 where there are fewer.

    Points enter in lots that double, up to 2 % of all: each lot is searched in the graph of those before it, what a search
    meets is pruned to the point's links, and points that are linked to are linked back, and pruned when they have too many.
    """
    n = len(vectors)
    points = scaled(vectors, vectors)
    norms = np.einsum("ij,ij->i", points, points)
    start = int(np.argmin(norms - 2 * points @ points.mean(0)))
    links = np.full((n + 1, degree), -1)
    order = np.r_[start, np.delete(np.arange(n), start)]
    done = 1
    while done < n:
        lot = order[done : done + max(1, min(done, n // 50 + 1))]
        back_from, back_to = [], []
        for i in range(0, len(lot), TOGETHER):
            own = lot[i : i + TOGETHER]
            met, _ = beam_search(points, norms, links, start, points[own], width)
            links[own] = robust_prune(points, norms, own, np.concatenate([met, links[own]], 1), degree, slack)
        to, at = links[lot].ravel(), np.repeat(lot, degree)
        back_to, back_from = to[to >= 0], at[to >= 0]
        by = np.lexsort((back_from, back_to))
        back_to, back_from = back_to[by], back_from[by]
        targets, first, counts = np.unique(back_to, return_index=True, return_counts=True)
        have = (links[targets] >= 0).sum(1)
        for wide in np.unique(np.minimum(-(-counts // degree), 8)):  # targets with like numbers of new links together
            some = np.flatnonzero(np.minimum(-(-counts // degree), 8) == wide)
            most = int(counts[some].max())
            for i in range(0, len(some), max(1, TOGETHER // int(wide))):
                part = some[i : i + max(1, TOGETHER // int(wide))]
                extra = np.full((len(part), most), -1)
                column = np.arange(most)[None, :] < counts[part][:, None]
                extra[column] = back_from[(first[part][:, None] + np.arange(most))[column]]
                both = np.concatenate([links[targets[part]], extra], 1)
                fits = have[part] + counts[part] <= degree
                full = ~fits
                if fits.any():
                    links[targets[part[fits]]] = -np.sort(-both[fits], 1)[:, :degree]
                if full.any():
                    links[targets[part[full]]] = robust_prune(points, norms, targets[part[full]], both[full], degree, slack)
        done += len(lot)
    return links[:n].astype(np.int32), start


# ---------------------------------------------------------------- Spark


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vec (little-endian doubles; 0 for -0) of the vectors that take part."""

    def start():
        def raw(part: pa.RecordBatch):
            places, out = [], []
            for place, v in enumerate(part.column("embedding").to_pylist()):
                if v and not any(x is None for x in v):
                    x = np.asarray(v, "<f8") + 0.0
                    if np.isfinite(x).all() and x.any():
                        places.append(place)
                        out.append(x.tobytes())
            return places, [out]

        return raw

    rows = vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return mapped(rows, ["vec_id"], {"vec": "binary"}, start)


def _first(df: DataFrame, key: str, k: int, *order: str) -> DataFrame:
    """The first k rows of each key; tasks send on k of theirs at most, so a key of any size costs k rows a task."""
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_at") <= k).drop("_at")


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; scaled where squares would overflow or vanish."""
    with np.errstate(over="ignore", under="ignore"):
        gap = vectors - query
        out = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        odd = ~np.isfinite(out) | (out < 1e-140)
    if odd.any():
        halves = vectors[odd] / 2 - query / 2
        top = np.abs(halves).max(1)
        unit = halves / np.where(top > 0, top, 1)[:, None]
        with np.errstate(over="ignore"):
            out[odd] = 2 * top * np.sqrt(np.einsum("ij,ij->i", unit, unit))
    return out


class Index:
    """A built index: shards in files of the shared folder, and which distinct vector has which ids."""

    def __init__(self, folder: str, shards: DataFrame, units: DataFrame, reps: DataFrame, k: int):
        self.folder, self.shards, self.units, self.reps, self.k = folder, shards, units, reps, k


def build_index(vectors: DataFrame, k: int = 10) -> Index:
    """Indexes every vector: distinct ones are dealt to shards by a hash, and a task builds the graph of a shard and writes
    it as a file (vectors, links, ids). For a vector that stands often the k + 1 least ids are kept, all that k results need."""
    spark = vectors.sparkSession
    units = stash(_usable(vectors), "units")
    shape = units.select("vec").distinct().groupBy(F.octet_length("vec").alias("bytes")).agg(F.count(F.lit(1)).alias("rows"))
    cores = 2 * spark.sparkContext.defaultParallelism
    most = F.least(F.lit(SHARD), F.greatest(F.ceil(F.col("rows") / cores), F.lit(LEAST_SHARD)), F.greatest(F.floor(F.lit(SHARD_BYTES) / F.col("bytes")), F.lit(1)))
    shape = shape.withColumn("shards", F.ceil(F.col("rows") / most).cast("long")).drop("rows")
    ids = _first(units, "vec", k + 1, "vec_id").groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    lot = F.concat_ws("-", F.col("bytes").cast("string"), F.pmod(F.xxhash64("vec"), F.col("shards")).cast("string"))
    reps = ids.withColumn("bytes", F.octet_length("vec")).join(F.broadcast(shape), "bytes").select(F.xxhash64("vec").alias("rep"), "vec", "ids", lot.alias("shard"))
    reps = stash(reps, "reps")
    folder = new_folder(spark, "graph")

    def index(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["rep", "vec"])
        points = np.frombuffer(b"".join(group["vec"]), "<f8").reshape(len(group), -1)
        links, start = build(points)
        counts = np.array([len(x) for x in group["ids"]], "<i8")
        head = np.array([len(points), points.shape[1], links.shape[1], start], "<i8")
        write_arrays(folder, key[0], head, points, counts, np.concatenate(list(group["ids"])).astype("<i8"), links.astype("<i4"))
        return pd.DataFrame({"shard": [key[0]], "bytes": [points.shape[1] * 8], "rows": [len(points)]})

    n = shape.agg(F.sum("shards")).first()[0] or 1
    shards = reps.repartition(tasks_for(n), "shard").groupBy("shard").applyInPandas(index, "shard string, bytes int, rows long")
    return Index(folder, stash(shards, "shards"), units, reps, k)


def _shard(files: Files, name: str) -> tuple:
    raw = files[name]
    n, d, degree, start = raw[:32].view("<i8").tolist()
    at = np.cumsum([32, 8 * n * d, 8 * n])
    points, counts = raw[at[0] : at[1]].view("<f8").reshape(n, d), raw[at[1] : at[2]].view("<i8")
    ends = np.cumsum(counts)
    total = int(ends[-1])
    ids = raw[at[2] : at[2] + 8 * total].view("<i8")
    links = raw[at[2] + 8 * total :].view("<i4").reshape(n, degree)
    small = scaled(points, points)
    return points, small, np.einsum("ij,ij->i", small, small), np.r_[links, np.full((1, degree), -1, "<i4")], start, ids, ends - counts, ends


def nearest(index: Index, queries: DataFrame, width: int = 2 * BEAM) -> DataFrame:
    """rep, found (array of (score, vec_id), the k + 1 nearest, ties to the smaller id) for queries (rep, vec): every shard is
    searched for every block of queries, as a task of its own; tasks return k + 1 rows a query, with exact distances."""
    spark, k = queries.sparkSession, index.k
    sizes = stash(queries.groupBy(F.octet_length("vec").alias("bytes")).agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("blocks")), "sizes")
    block = F.concat_ws("-", F.lit("q"), F.col("bytes").cast("string"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("string"))
    dealt = queries.withColumn("bytes", F.octet_length("vec")).join(F.broadcast(sizes), "bytes").select("rep", "vec", block.alias("block"), "bytes")
    folder = index.folder

    def write(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep")
        write_arrays(folder, key[0], np.array([len(group), group["bytes"].iloc[0] // 8], "<i8"), group["rep"].to_numpy("<i8"), np.frombuffer(b"".join(group["vec"]), "<f8"))
        return pd.DataFrame({"block": [key[0]], "bytes": [group["bytes"].iloc[0]]})

    blocks = stash(dealt.groupBy("block").applyInPandas(write, "block string, bytes int"), "blocks")
    work = stash(index.shards.join(blocks, "bytes").select("shard", "block"), "work")
    n = work.count()

    def start():
        files = Files(folder)

        def search(part: pa.RecordBatch):
            reps, scores, found = [], [], []
            for name, block in zip(part.column("shard").to_pylist(), part.column("block").to_pylist(), strict=True):
                points, small, norms, links, begin, ids, firsts, ends = _shard(files, name)
                raw = files[block]
                m, d = raw[:16].view("<i8").tolist()
                own, asked = raw[16 : 16 + 8 * m].view("<i8"), raw[16 + 8 * m :].view("<f8").reshape(m, d)
                for i in range(0, m, TOGETHER):
                    met, _ = beam_search(small, norms, links, begin, scaled(asked[i : i + TOGETHER], points), width)
                    for rep, q, who in zip(own[i : i + TOGETHER].tolist(), asked[i : i + TOGETHER], met, strict=True):
                        who = who[who >= 0]
                        far = distances(points[who], q)
                        each = ends[who] - firsts[who]
                        all_ids = np.concatenate([ids[a:b] for a, b in zip(firsts[who].tolist(), ends[who].tolist(), strict=True)])
                        far = np.repeat(far, each)
                        best = np.lexsort((all_ids, far))[: k + 1]
                        reps += [rep] * len(best)
                        scores += far[best].tolist()
                        found += all_ids[best].tolist()
            return [0] * len(reps), [reps, scores, found]

        return search

    rows = mapped(work.repartition(tasks_for(n)), ["block"], {"rep": "long", "score": "double", "vec_id": "long"}, start, 1)
    rows = _first(rows.drop("block"), "rep", k + 1, "score", "vec_id")
    return rows.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("found"))


def search(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each vector whose vec_id is divisible by `every`.

    Nearness is the Euclidean distance of the original vectors in double precision; results are ordered by it, then by
    vec_id. The graph proposes, so a neighbour can be missed; what is returned has its exact score. Vectors of one length
    are searched among themselves. Equal vectors are indexed once and all their rows are found.

    Rows whose vector is null, empty, zero, or holds null or non-finite components, and rows without a vec_id, take no part.
    Of a vec_id that stands twice each row is a query and a candidate for the other; only a query's own row is left out.
    With fewer candidates all are returned. An empty table gives an empty result. vec_id must be a whole number; other columns
    are not looked at.
    """
    index = build_index(vectors, k)
    asked = index.units.where(F.col("vec_id") % every == 0)
    numbers = stash(asked.select("vec").distinct().select(F.monotonically_increasing_id().alias("rep"), "vec"), "asked")  # the numbers hold from here on
    found = stash(nearest(index, numbers), "found")
    own = F.array_position(F.transform("found", lambda x: x["vec_id"]), F.col("vec_id")).cast("int")
    others = F.when(own == 0, F.slice("found", 1, k)).otherwise(F.slice(F.concat(F.slice("found", F.lit(1), F.greatest(own - 1, F.lit(0))), F.slice("found", own + 1, k + 1)), 1, k))
    rows = asked.join(numbers, "vec").select("vec_id", "rep").join(found, "rep").select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "hit"))
    return rows.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
