"""Exact cosine range join: pivots partition the vectors, the triangle inequality says which cells a vector is copied to."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Sent, blocks_of, by_value, components, mapped, stash, tasks_for

by_value(__name__)

#: A cell is split by so many pivots of its own, if it has more than SMALL vectors and more than one of PARTS; so there are a
#: few times PARTS cells at most. Pivots of up to CELLS cells are broadcast at once.
PIVOTS, SMALL, PARTS, CELLS = 64, 2048, 32_768, 512
#: A split counts if it leaves, for each vector, so many fewer others to compare with; where it doesn't, vectors lie about as far
#: from all pivots, and the cell is joined in blocks.
WORTH = 0.5
#: The cell of all vectors of a length is numbered by it from here on, and part k of cell c is c * PIVOTS + k.
ROOT = 1 << 20
#: Vectors in a block.
BLOCK = 8192
#: Slack for rounding in the bounds; the join itself compares the cosine with the threshold.
EPS = 1e-9


def spanning(match: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column) that join the same rows and columns as all true cells do; each row and column is met once."""
    out, rows_left, cols_left = [], match.any(1), np.ones(match.shape[1], bool)
    while rows_left.any():
        front = np.array([int(np.argmax(rows_left))])
        rows_left[front] = False
        while len(front):
            part = match[front] & cols_left
            cols = np.flatnonzero(part.any(0))
            if not len(cols):
                break
            out += zip(front[part[:, cols].argmax(0)].tolist(), cols.tolist(), strict=True)
            cols_left[cols] = False
            part = match[:, cols] & rows_left[:, None]
            front = np.flatnonzero(part.any(1))
            out += zip(front.tolist(), cols[part[front].argmax(1)].tolist(), strict=True)
            rows_left[front] = False
    return out


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, vec (little-endian doubles of norm 1) of the vectors; vec is null for those that link with nothing."""

    def start():
        def scale(part: pa.RecordBatch):
            out = []
            for v in part.column("embedding").to_pylist():
                unit = None
                if v and not any(x is None for x in v):
                    x = np.asarray(v, float)
                    if np.isfinite(x).all() and (top := np.abs(x).max()) > 0:
                        x = x / top  # squares neither overflow nor vanish
                        unit = (x / math.sqrt(float(x @ x)) + 0.0).astype("<f8").tobytes()
                out.append(unit)
            return None, [out]

        return scale

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(T.ArrayType(T.DoubleType())).alias("embedding"))
    return mapped(rows, ["vec_id"], {"vec": "binary"}, start)


def _matrix(vecs) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), "<f8").reshape(len(vecs), -1)


def _distances(vecs: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * vecs @ pivots.T, 0))


def _placed(rows: DataFrame, pivots: dict[int, np.ndarray], radii: dict[int, np.ndarray] | None, reach: float) -> DataFrame:
    """Rows (sub, home, far, rep, size, vec) from rows (cell, home, rep, size, vec): a vector at home in a cell is at home with
    its nearest pivot there. If radii are given, it is also a guest in each earlier part that may hold a vector within
    reach, and a guest of the cell is one in every such part.

    For x at home with pivot i and y with pivot j, d(x, y) <= reach implies d(y, i) <= d(y, j) + 2 reach, d(y, i) <=
    radius(i) + reach, and that y is within reach of the plane between i and j.
    """
    sent = Sent(rows.sparkSession, (pivots, radii))

    def start():
        pivots, radii = sent()
        between = {c: _distances(p, p) for c, p in pivots.items()}

        def place(part: pa.RecordBatch):
            cells, at_home = np.array(part.column("cell"), np.int64), np.array(part.column("home"))
            vecs = np.array(part.column("vec").to_pylist(), object)
            rows_, subs, homes, fars = [], [], [], []
            for cell in np.unique(cells).tolist():
                own_rows = np.flatnonzero(cells == cell)
                p, home_here = pivots[cell], at_home[own_rows]
                d = _distances(_matrix(vecs[own_rows]), p)
                home = d.argmin(1)
                own = d[np.arange(len(d)), home]
                rows_.append(own_rows[home_here])
                subs.append(cell * PIVOTS + home[home_here])
                homes.append(np.ones(home_here.sum(), bool))
                fars.append(own[home_here])
                if radii is not None:
                    gap = between[cell][:, home].T
                    plane = np.divide(d**2 - own[:, None] ** 2, 2 * gap, out=np.zeros_like(d), where=gap > 0)
                    near = (d <= own[:, None] + 2 * reach + EPS) & (d <= radii[cell] + reach + EPS) & (plane <= reach + EPS)
                    near[home_here] &= np.arange(len(p)) < home[home_here][:, None]
                    guest, sub = np.nonzero(near)
                    rows_.append(own_rows[guest])
                    subs.append(cell * PIVOTS + sub)
                    homes.append(np.zeros(len(guest), bool))
                    fars.append(own[guest])
            if not rows_:
                return [], [[], [], []]
            return np.concatenate(rows_), [np.concatenate(x) for x in (subs, homes, fars)]

        return place

    names = {"sub": "long", "here": "boolean", "far": "double"}
    placed = mapped(rows.select("cell", "home", "rep", "size", "vec"), ["rep", "size", "vec"], names, start, 2_000)
    return placed.withColumnRenamed("here", "home")


def _split(rows: DataFrame, big: list[int], reach: float, small: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """Cells `big` of rows split by pivots of their own: the parts, the rows of cells that splitting doesn't help, and which parts are big."""
    rows = rows.where(F.col("cell").isin(big))
    order = F.struct(F.xxhash64("rep").alias("h"), "vec")
    dealt = rows.where("home").withColumn("lot", F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(PIVOTS)))
    chosen = dealt.groupBy("cell", "lot").agg(F.min(order)["vec"].alias("vec")).collect()
    pivots = {c: _matrix([r["vec"] for r in sorted(chosen, key=lambda r: r["lot"]) if r["cell"] == c]) for c in big}
    far = _placed(rows.where("home"), pivots, None, reach).groupBy("sub").agg(F.max("far").alias("far")).collect()
    radii = {c: np.full(len(p), -math.inf) for c, p in pivots.items()}
    for r in far:
        radii[r["sub"] // PIVOTS][r["sub"] % PIVOTS] = r["far"]
    counted = _placed(rows, pivots, radii, reach).groupBy("sub").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("guests")).collect()
    whole = {r["cell"]: (r["homes"], r["guests"]) for r in rows.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("guests")).collect()}
    work = lambda homes, guests: homes * (homes / 2 + guests)
    after = dict.fromkeys(big, 0.0)
    for r in counted:
        after[r["sub"] // PIVOTS] += work(r["homes"], r["guests"])
    helped = [c for c in big if after[c] < WORTH * work(*whole[c])]
    still = [r["sub"] for r in counted if r["sub"] // PIVOTS in helped and r["homes"] > small]
    parts = _placed(rows.where(F.col("cell").isin(helped)), pivots, radii, reach).select(F.col("sub").alias("cell"), "home", "rep", "size", "vec")
    return parts, rows.where(~F.col("cell").isin(helped)), still


def _join_blocks(threshold: float):
    def join(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        """Links between the two blocks of a cell, or within its one block: counts of linked vectors, and links that span them."""
        _, first, second = key
        left = group[group["home"] & (group["block"] == first)].sort_values("rep")
        right = left if first == second else group[group["block"] == second].sort_values("rep")
        rows: list = []
        if len(left) and len(right):
            a, b = _matrix(list(left["vec"])), _matrix(list(right["vec"]))
            match = np.empty((len(a), len(b)), bool)
            for i in range(0, len(a), 512):
                match[i : i + 512] = a[i : i + 512] @ b.T >= threshold
            if first == second:
                np.fill_diagonal(match, False)
            ids, others = left["rep"].to_numpy(), right["rep"].to_numpy()
            rows = [(r, int(n), None) for r, n in zip(ids, match @ right["size"].to_numpy(), strict=True) if n]
            if first != second:
                rows += [(r, int(n), None) for r, n in zip(others, left["size"].to_numpy() @ match, strict=True) if n]
            rows += [(ids[i], 0, others[j]) for i, j in spanning(match)]
        return pd.DataFrame(rows, columns=["rep", "links", "other"]).astype({"other": "Int64"})

    return join


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows for each pair of blocks that is compared, a task or more for each: homes with all blocks of their cell, guests with those of homes."""
    shape = rows.groupBy("cell").agg(
        F.count_if("home").alias("rows"), F.count_if(~F.col("home")).alias("guests"), F.sum(F.when(F.col("home"), F.octet_length("vec"))).alias("bytes")
    )
    blocks = F.greatest(blocks_of(BLOCK), F.least(F.lit(8), F.ceil(F.col("rows") / 1024))).cast("int")  # a few for more tasks than one
    shape = shape.where("rows > 0").select("cell", blocks.alias("homes"), F.ceil(F.col("guests") * blocks / F.col("rows")).cast("int").alias("visits"))
    shape = stash(shape, "shape")
    groups = shape.agg(F.sum(F.col("homes") * ((F.col("homes") + 1) / 2 + F.col("visits")))).first()[0] or 1
    number = F.xxhash64("rep")
    dealt = rows.join(shape, "cell").withColumn(
        "block", F.when(F.col("home"), F.pmod(number, F.col("homes"))).otherwise(F.col("homes") + F.pmod(number, F.greatest("visits", F.lit(1))))
    )
    partner = F.when(F.col("home"), F.sequence(F.lit(0), F.col("homes") + F.col("visits") - 1)).otherwise(F.sequence(F.lit(0), F.col("homes") - 1))
    return dealt.withColumn("other", F.explode(partner)).select(
        "cell", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "home", "rep", "size", "vec"
    ).repartition(tasks_for(groups), "cell", "first", "second")


def cell_pairs(reps: DataFrame, threshold: float) -> DataFrame:
    """Distinct vectors (rep, size, vec), dealt to cells and these to pairs of blocks: every two that may be as alike as the threshold meet once."""
    reach = math.sqrt(2 - 2 * threshold)
    rows = reps.select((ROOT + F.octet_length("vec") / 8).cast("long").alias("cell"), F.lit(True).alias("home"), "rep", "size", "vec")
    counts = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}
    small = max(SMALL, sum(counts.values()) // PARTS)
    big, done = [c for c, n in counts.items() if n > small], []
    while big:
        done.append(rows.where(~F.col("cell").isin(big)))
        parts, more = [], []
        for i in range(0, len(big), CELLS):
            split, whole, still = _split(rows, big[i : i + CELLS], reach, small)
            parts.append(stash(split, "cells"))
            done.append(whole)
            more += still
        rows, big = reduce(DataFrame.unionByName, parts), more
    return _in_blocks(reduce(DataFrame.unionByName, [*done, rows]))


def cosine_links(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept.

    Equal vectors are one class with its size, so a vector that a third of the rows repeat costs what one does. Cells
    with many vectors are split by pivots of their own, again and again, as long as that saves comparisons; where it
    doesn't (vectors about as far from one another as from all pivots), the cell is cut into blocks of rows that are
    joined two by two. Tasks return counts and links that span, never all pairs.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Repeated rows link like
    equal vectors, a vec_id that stands twice has a row for each vector. A null vec_id counts in no smallest one and is
    kept. An empty table gives an empty result. Vectors of different lengths link only with their like: pass one length.
    """
    units = stash(unit_vectors(vectors), "units")
    reps = units.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("size"))
    reps = stash(reps.select(F.monotonically_increasing_id().alias("rep"), "least", "size", "vec"), "reps")  # the numbers hold from here on
    pairs = cell_pairs(reps, threshold)
    found = stash(pairs.groupBy("cell", "first", "second").applyInPandas(_join_blocks(threshold), "rep long, links long, other long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links")).withColumnRenamed("rep", "_r")
    roots = components(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    roots = stash(roots.join(reps.select(F.col("rep").alias("v"), "least"), "v"), "roots")
    roots = roots.join(roots.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("v", "component_id")
    of_rep = (
        reps.join(links, F.col("rep") == F.col("_r"), "left")
        .join(roots, F.col("rep") == F.col("v"), "left")
        .select("vec", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    )
    least = F.coalesce("component_id", "vec_id")
    return units.join(of_rep, "vec", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), least.alias("component_id"), F.coalesce(F.col("vec_id") == least, F.lit(True)).alias("kept")
    )
