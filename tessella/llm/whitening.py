"""Whitening by spectrum slicing: inertia counts isolate each leading eigenvalue of the covariance, Rayleigh quotients find it."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sent, by_value, stash

by_value(__name__)

#: x = floor(SCALE * entry) + SHIFT. Entries of LARGEST or more don't fit in a long as x.
SCALE, SHIFT, LARGEST = 64, 1_000_000, 2.0**55
#: Rows that a task multiplies at once, and groups in which the tasks' sums are added first.
ROWS, LOTS = 4096, 64
_WIDE = 1 << 62


# ---------------------------------------------------------------- eigenvalues of a symmetric matrix, on the driver


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues exceed the shift: the positive inertia of matrix - shift, from its factors L D L' with pivots of
    one or two rows, chosen so that the factors don't grow (Bunch and Kaufman). A pivot of two has one eigenvalue of each sign."""
    a = matrix - shift * np.eye(len(matrix))
    n, k, found, bound = len(a), 0, 0, (1 + math.sqrt(17)) / 8
    while k < n:
        step, pivot = 1, k
        if k < n - 1:
            beside = np.abs(a[k + 1 :, k])
            far = k + 1 + int(beside.argmax())
            most = beside[far - k - 1]
            if abs(a[k, k]) < bound * most:
                line = np.abs(a[far, k:])
                line[far - k] = 0
                widest = line.max()
                if abs(a[k, k]) * widest < bound * most * most:
                    step, pivot = (1, far) if abs(a[far, far]) >= bound * widest else (2, far)
        last = k + step - 1
        if pivot != last:
            a[[last, pivot], k:] = a[[pivot, last], k:]
            a[k:, [last, pivot]] = a[k:, [pivot, last]]
        below = a[k + step :, k : k + step]
        if step == 1:
            d = a[k, k]
            found += d > 0
            if d != 0:
                a[k + 1 :, k + 1 :] -= np.outer(below[:, 0] / d, below[:, 0])
        else:
            found += 1
            a[k + 2 :, k + 2 :] -= below @ np.linalg.solve(a[k : k + 2, k : k + 2], below.T)
        k += step
    return int(found)


def _solved(matrix: np.ndarray, shift: float, v: np.ndarray, tiny: float) -> np.ndarray:
    """The direction of (matrix - shift)^-1 v."""
    for s in (shift, shift + tiny, shift - 3 * tiny):
        try:
            w = np.linalg.solve(matrix - s * np.eye(len(v)), v)
        except np.linalg.LinAlgError:
            continue
        size = np.abs(w).max()
        if np.isfinite(size) and size > 0:
            w = w / size
            return w / np.linalg.norm(w)
    return v


def _clear(v: np.ndarray, vectors: list[np.ndarray]) -> np.ndarray:
    """v without its parts along the vectors, at unit length."""
    for _ in range(2):
        for u in vectors:
            v = v - (u @ v) * u
    return v / np.linalg.norm(v)


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest `most` eigenvalues above rounding of a symmetric matrix without negative ones, falling, and their unit
    vectors as columns; the entry of largest size is positive.

    Bisection halves an interval until counts show one eigenvalue in it; Rayleigh quotient iteration starts in its middle and
    counts only if it ends inside. Eigenvalues that agree to rounding share an interval and get any orthonormal vectors.
    Counts on both sides of each result certify its number; a number that they don't bear out raises.
    """
    norm = float(np.abs(matrix).sum(1).max()) if len(matrix) else 0.0
    if norm == 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    tiny = 8 * len(matrix) * np.finfo(float).eps * norm
    seen: dict[float, int] = {2 * norm: 0}

    def count(shift: float) -> int:
        if shift not in seen:
            seen[shift] = above(matrix, shift)
        return seen[shift]

    draws = np.random.default_rng(7)
    values: list[float] = []
    vectors: list[np.ndarray] = []
    wanted = min(most, count(tiny))
    while len(values) < wanted:
        number = len(values) + 1
        low = max(s for s, c in seen.items() if c >= number)
        high = min(s for s, c in seen.items() if c < number)
        while True:
            alone = count(low) == number and count(high) == number - 1
            middle = (low + high) / 2
            if alone or high - low <= tiny:
                v = _clear(draws.standard_normal(len(matrix)), vectors)
                for _ in range(3):
                    v = _clear(_solved(matrix, middle, v, tiny), vectors)
                value = float(v @ matrix @ v)
                best = (math.inf, value, v)
                for _ in range(12 if alone else 0):
                    gone = float(np.abs(matrix @ v - value * v).max())
                    if gone >= best[0] and best[0] <= tiny:
                        break
                    best = min(best, (gone, value, v), key=lambda x: x[0])
                    v = _solved(matrix, value, v, tiny / 64)
                    value = float(v @ matrix @ v)
                gone, value, v = best if alone else (0.0, value, v)
                slack = tiny if high - low <= tiny else 0.0
                if gone <= tiny and low - slack <= value <= high + slack:
                    values.append(value)
                    vectors.append(_clear(v, vectors))
                    break
                if high - low <= tiny:
                    raise ArithmeticError(f"eigenvalue {number} isn't in the interval that holds it")
            low, high = (middle, high) if count(middle) >= number else (low, middle)
    order = sorted(range(len(values)), key=lambda i: -values[i])
    values, vectors = [values[i] for i in order], [vectors[i] for i in order]
    for number, value in enumerate(values, 1):
        if above(matrix, value - 2 * tiny) < number or above(matrix, value + 2 * tiny) >= number:
            raise ArithmeticError(f"counts don't bear out the number of eigenvalue {number}")
    vectors = [v * np.sign(v[np.abs(v).argmax()]) for v in vectors]
    return np.array(values), np.array(vectors).reshape(len(values), len(matrix)).T


# ---------------------------------------------------------------- passes over the vectors


def lattice(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places of rows, whole numbers x) of the vectors that take part, for each length met."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == d)
        entries = flat[starts[rows][:, None] + np.arange(d)].astype(float)
        with np.errstate(invalid="ignore"):
            good = (np.abs(entries) < LARGEST).all(1)  # false for NaN, infinite and null entries
        yield d, rows[good], np.floor(SCALE * entries[good]).astype(np.int64) + SHIFT


def from_mean(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: longs, or Python's integers where longs might not do."""
    most = max(map(abs, sums), default=0)
    if len(x) and n * int(np.abs(x).max()) + most < _WIDE:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _each(batches, length: int | None = None):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            for d, rows, x in lattice(part.column("embedding")):
                if len(rows) and length in (None, d):
                    yield part, d, rows, x


def _doubles(vectors: DataFrame, *names: str) -> DataFrame:
    return vectors.select(*[F.col(c).cast("long").alias(c) for c in names], F.col("embedding").cast("array<double>").alias("embedding"))


def _counted(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """The length that most vectors have (the longest of these), their number n and the sums S of their x."""

    def add(batches):
        counts: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for _, d, rows, x in _each(batches):
            counts[d] = counts.get(d, 0) + len(rows)
            small = int(np.abs(x).max()) * len(x) < _WIDE
            sums[d] = sums.get(d, 0) + (x.sum(0) if small else x.astype(object).sum(0)).astype(object)
        out = [(d, i, counts[d], Decimal(int(s))) for d in sums for i, s in enumerate(sums[d])]
        cols = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)))]
        yield pa.RecordBatch.from_arrays(cols, names=["length", "dim", "n", "total"])

    parts = _doubles(vectors).mapInArrow(add, "length int, dim int, n long, total decimal(38,0)")
    sums = stash(parts.groupBy("length", "dim").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total")), "sums")
    top = sums.where("dim = 0").orderBy(F.desc("n"), F.desc("length")).first()
    if top is None:
        return 0, 0, []
    found = sums.where(F.col("length") == top["length"]).orderBy("dim").collect()  # a row for each dimension
    return top["length"], top["n"], [int(r["total"]) for r in found]


def _products(vectors: DataFrame, length: int, make) -> np.ndarray:
    """The sum of y'y over the blocks y = make(x) of all vectors of the length: each task sums its own, a row of the sum is
    added up in LOTS groups and then in one, in the order of tasks."""

    def multiply(batches):
        from pyspark import TaskContext

        total = None
        for *_, x in _each(batches, length):
            y = make(x)
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            task = TaskContext.get().partitionId()
            raw = [row.astype("<f8").tobytes() for row in total]
            cols = [pa.array([task] * len(raw), pa.int64()), pa.array(range(len(raw)), pa.int32()), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["task", "row", "sums"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("task")
        total = np.sum([np.frombuffer(v, "<f8") for v in group["sums"]], axis=0)
        return pd.DataFrame({"task": [group["task"].min()], "row": [group["row"].iloc[0]], "sums": [total.tobytes()]})

    schema = "task long, row int, sums binary"
    parts = _doubles(vectors).mapInArrow(multiply, schema)
    parts = parts.groupBy("row", F.pmod("task", F.lit(LOTS))).applyInPandas(add, schema)
    found = parts.groupBy("row").applyInPandas(add, schema).collect()  # a square matrix of the vectors' length
    return np.array([np.frombuffer(r["sums"], "<f8") for r in sorted(found, key=lambda r: r["row"])])


SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, most: int = 32) -> DataFrame:
    """For each vector and leading component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    An entry c is x = floor(64 c) + 1000000. S are the sums of x over all n vectors, deviation is the sum of (n x - S)^2 over
    dimensions (exact; null beyond 38 digits), whitened is x - S/n along the component over the square root of its eigenvalue,
    explained the eigenvalue's share of the trace, identity_error the largest distance of the whitened values' covariance from
    the identity. Three passes over the vectors: sums, products of what is centred, products of what is whitened; then one
    that returns rows. The driver holds square matrices of the vectors' length only.

    Vectors that are null, empty, or hold null or non-finite entries are left out, and so are entries of 2^55 and more, which
    aren't longs as x, and vectors that haven't the length that most have (the longest of these). Repeated rows count as often
    as they stand and each gets its rows; a null vec_id stays null (ids must be whole numbers). Eigenvalues that are 0 up to
    rounding have no component, so equal vectors, or an empty table, give an empty result. Equal eigenvalues get any
    orthonormal components. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    length, n, sums = _counted(vectors)
    centred = lambda x: from_mean(x, n, sums).astype(float) / n
    covariance = _products(vectors, length, centred) / n if n else np.zeros((0, 0))
    values, axes = leading((covariance + covariance.T) / 2, most)
    if not len(values):
        return spark.createDataFrame([], SCHEMA)
    axes = axes / np.sqrt(values)
    beside = _products(vectors, length, lambda x: np.hstack([centred(x) @ axes, np.ones((len(x), 1))])) / n
    off = beside[:-1, :-1] - np.outer(beside[-1, :-1], beside[-1, :-1]) - np.eye(len(values))
    explained, error = values / np.trace(covariance), float(np.abs(off).max())
    k = len(values)
    sent = Sent(spark, (sums, axes, explained))

    def project(batches):
        sums, axes, explained = sent()
        for part, _, rows, x in _each(batches, length):
            z = from_mean(x, n, sums)
            if z.dtype == object or int(np.abs(z).max()) ** 2 * length >= _WIDE:
                z = z.astype(object)
            deviation = [None if v >= 10**38 else Decimal(int(v)) for v in (z * z).sum(1)]
            m, again = len(rows), pa.array(np.repeat(np.arange(len(rows)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id").take(pa.array(np.repeat(rows, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array(deviation, pa.decimal128(38, 0)).take(again),
                    pa.array((z.astype(float) / n @ axes).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return _doubles(vectors, "vec_id").mapInArrow(project, SCHEMA)
