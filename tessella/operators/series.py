"""Series of one value a day: masks, gaps, imputation, trends. All work on long form (patient, measure, day, value)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import constants as C
from tessella.functions.shared import written
from tessella.functions.shipping import by_value

from .position import quantiles

by_value(__name__)

SERIES = ["patient", "measure"]


def dense(cells: DataFrame, first: int, last: int) -> DataFrame:
    """Every day from first to last of each series that has a value; days without one are null."""
    days = cells.groupBy(*SERIES).agg(F.map_from_entries(F.collect_list(F.struct("day", "value"))).alias("values"))
    grid = days.select(*SERIES, "values", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    return grid.select(*SERIES, "day", F.try_element_at("values", F.col("day")).alias("value"))


def _by_day(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("day")


def mask_delta(obs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """mask: 1 where observed; delta: days since the last observation, -1 before the first."""
    past = _by_day(keys or SERIES).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("value").isNotNull(), F.col("day")), ignorenulls=True).over(past)
    return obs.withColumn("mask", F.col("value").isNotNull().cast("int")).withColumn("delta", F.coalesce(F.col("day") - seen, F.lit(-1)))


def neighbours(obs: DataFrame) -> DataFrame:
    """Day and value of the last observation up to each day and of the first from it on."""
    past = _by_day(SERIES).rowsBetween(Window.unboundedPreceding, 0)
    ahead = _by_day(SERIES).rowsBetween(0, Window.unboundedFollowing)
    day = F.when(F.col("value").isNotNull(), F.col("day"))
    return (
        obs.withColumn("left_day", F.last(day, ignorenulls=True).over(past))
        .withColumn("left_value", F.last("value", ignorenulls=True).over(past))
        .withColumn("right_day", F.first(day, ignorenulls=True).over(ahead))
        .withColumn("right_value", F.first("value", ignorenulls=True).over(ahead))
    )


def clipped(value: Column, measure: Column) -> Column:
    """Values kept within what the measure can be; measures without limits pass."""
    low = F.create_map(*[F.lit(x) for k, v in C.NOISE.items() for x in (k, v[1])])
    high = F.create_map(*[F.lit(x) for k, v in C.NOISE.items() for x in (k, v[2])])
    name = F.lower(measure)
    value = F.greatest(value, F.coalesce(F.try_element_at(low, name), value))
    return F.least(value, F.coalesce(F.try_element_at(high, name), value))


def hash_normal(seed: int, *keys: Column) -> Column:
    """A standard normal number that depends on the keys alone, by Box and Muller from two hashes."""
    unit = lambda salt: (F.pmod(F.xxhash64(*keys, F.lit(seed), F.lit(salt)), F.lit(2**31 - 1)) + 1) / F.lit(2.0**31)
    return F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * np.pi * unit(2))


def noise(seed: int) -> Column:
    """Noise of a cell by its measure's deviation; measures without one have none."""
    sigma = F.create_map(*[F.lit(x) for k, v in C.NOISE.items() for x in (k, v[0])])
    scale = F.coalesce(F.try_element_at(sigma, F.lower("measure")), F.lit(0.0))
    return scale * hash_normal(seed, F.col("patient"), F.col("measure"), F.col("day"))


def impute_linear(obs: DataFrame, max_gap: int = 2, seed: int | None = None) -> DataFrame:
    """Fills inner gaps of up to max_gap days on the line between their neighbours; ends stay null. seed: adds noise."""
    near = neighbours(obs)
    gap = F.col("right_day") - F.col("left_day") - 1
    line = F.col("left_value") + (F.col("right_value") - F.col("left_value")) * (F.col("day") - F.col("left_day")) / (gap + 1)
    if seed is not None:
        line = line + noise(seed)
    fill = F.col("value").isNull() & gap.between(1, max_gap)
    return near.select(
        *SERIES,
        "day",
        F.when(fill, clipped(line, F.col("measure"))).otherwise(F.col("value")).alias("value"),
        F.coalesce(fill, F.lit(False)).cast("int").alias("imputed"),
    )


def gap_report(obs: DataFrame, max_gap: int = 2) -> DataFrame:
    """For each measure and day: cells observed, filled and left null."""
    filled = impute_linear(obs, max_gap)
    return filled.groupBy("measure", "day").agg(
        F.count_if(F.col("value").isNotNull() & (F.col("imputed") == 0)).alias("observed"),
        F.count_if(F.col("imputed") == 1).alias("imputed"),
        F.count_if(F.col("value").isNull()).alias("kept_null"),
    )


def trends(obs: DataFrame) -> DataFrame:
    """Extremes, ends, count and largest fall and rise between neighbouring days of each series."""
    step = F.col("value") - F.lag("value").over(_by_day(SERIES))
    has = F.col("value").isNotNull()
    at = F.when(has, F.col("day"))
    return obs.withColumn("step", step).groupBy(*SERIES).agg(
        F.max("value").alias("highest"),
        F.min("value").alias("lowest"),
        (F.max("value") - F.min("value")).alias("spread"),
        F.min_by("value", at).alias("first_value"),
        F.max_by("value", at).alias("last_value"),
        F.count("value").alias("n_observed"),
        F.min("step").alias("max_dropdown"),
        F.max("step").alias("max_rise"),
    )


def trend_summary(obs: DataFrame) -> DataFrame:
    """Lowest and highest value with its (first) day, first against last and the change in percent."""
    seen = obs.where("value is not null")
    return seen.groupBy(*SERIES).agg(
        F.min(F.struct("value", "day"))["day"].alias("lowest_day"),
        F.max(F.struct(F.col("value"), -F.col("day")))["col2"].alias("_h"),
        F.min_by("value", "day").alias("first_value"),
        F.max_by("value", "day").alias("last_value"),
    ).select(
        *SERIES,
        "lowest_day",
        (-F.col("_h")).alias("highest_day"),
        "first_value",
        "last_value",
        F.when(F.col("first_value") != 0, (F.col("last_value") - F.col("first_value")) / F.col("first_value") * 100).alias("change_pct"),
    )


def trend_flags(obs: DataFrame, falling: str, rising: str, either: tuple[str, str]) -> DataFrame:
    """Per patient: `falling` fell in its last two steps, `rising` rose at all, both, and a rise of one of `either`."""
    seen = obs.where("value is not null")
    step = F.col("value") - F.lag("value").over(_by_day(SERIES))
    back = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("day")))
    steps = seen.withColumn("step", step).withColumn("back", back).where("step is not null")
    fell = F.coalesce(F.bool_and(F.when((F.col("measure") == falling) & (F.col("back") <= 2), F.col("step") < 0)), F.lit(False))
    rose = F.coalesce(F.bool_or(F.when(F.col("measure") == rising, F.col("step") > 0)), F.lit(False))
    up = F.coalesce(F.bool_or(F.when(F.col("measure").isin(*either), F.col("step") > 0)), F.lit(False))
    flags = steps.groupBy("patient").agg(fell.alias("falling"), rose.alias("rising"), up.alias("either_up"))
    return flags.select("patient", "falling", "rising", (F.col("falling") & F.col("rising")).alias("both"), "either_up")


def last_by_day(obs: DataFrame, measures: list[str]) -> DataFrame:
    """One column for each measure: the value of a patient and day."""
    return obs.groupBy("patient", "day").pivot("measure", measures).agg(F.max("value"))


def hours_between(events: DataFrame, key: str, time: str, ties: str) -> DataFrame:
    """Hours since the event before, within a key; (time, ties) leave no order open.

    Events are sorted into ranges of (key, time), so that a key with a third of all events has many; what the last event of a
    range tells the next is a row for each range at most.
    """
    dealt = written(events.select(key, ties, time).repartitionByRange(key, time, ties).withColumn("_part", F.spark_partition_id()))
    order = F.struct(F.col(time).isNotNull(), time, ties)
    last = dealt.groupBy(key, "_part").agg(F.max_by(F.struct(F.col(time).alias("t")), order)["t"].alias("_last"))
    before = Window.partitionBy(key).orderBy("_part")
    carried = last.select(F.col(key).alias("_key"), F.col("_part").alias("_own"), F.lag("_last").over(before).alias("_last")).where("_last IS NOT NULL")
    inside = F.lag(time).over(Window.partitionBy(key, "_part").orderBy(time, ties))
    joined = dealt.withColumn("_before", inside).join(F.broadcast(written(carried)), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_own")), "left")
    first = F.row_number().over(Window.partitionBy(key, "_part").orderBy(time, ties)) == 1
    micros = F.timestamp_diff("MICROSECOND", F.when(first, F.col("_last")).otherwise(F.col("_before")), F.col(time))
    return joined.select(key, ties, (micros / 3.6e9).alias("hours"))


def natural_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline with free ends through (x, y)."""
    n, h = len(x), np.diff(x).astype(float)
    a, b = np.zeros((n, n)), np.zeros(n)
    a[0, 0] = a[-1, -1] = 1
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    m = np.linalg.solve(a, b)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    u, v = x[k + 1] - at, at - x[k]
    return (m[k] * u**3 + m[k + 1] * v**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * u + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * v


def _curvatures(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Second derivatives of the natural splines through the first n points (x, y) of each row, by elimination along all rows at once."""
    h = np.diff(x, axis=1)
    inner = np.arange(1, x.shape[1] - 1)[None, :] < (n - 1)[:, None]
    slope = np.diff(y, axis=1) / np.where(h > 0, h, 1.0)
    low, high = np.where(inner, h[:, :-1], 0.0), np.where(inner, h[:, 1:], 0.0)
    middle, right = np.where(inner, 2 * (low + high), 1.0), np.where(inner, 6 * (slope[:, 1:] - slope[:, :-1]), 0.0)
    m = np.zeros(x.shape)
    above, value = np.zeros(inner.shape), np.zeros(inner.shape)
    for i in range(inner.shape[1]):
        pivot = middle[:, i] - (low[:, i] * above[:, i - 1] if i else 0.0)
        above[:, i] = high[:, i] / pivot
        value[:, i] = (right[:, i] - (low[:, i] * value[:, i - 1] if i else 0.0)) / pivot
    for i in reversed(range(inner.shape[1])):
        m[:, i + 1] = value[:, i] - above[:, i] * m[:, i + 2]
    return m


def _splined(v: np.ndarray, max_gap: int) -> np.ndarray:
    """The rows of v with inner gaps of up to max_gap filled (see impute_spline)."""
    seen, at = ~np.isnan(v), np.arange(v.shape[1])
    left = np.maximum.accumulate(np.where(seen, at, -1), 1)
    right = np.minimum.accumulate(np.where(seen, at, v.shape[1])[:, ::-1], 1)[:, ::-1]
    row, day = np.nonzero(~seen & (left >= 0) & (right < v.shape[1]) & (right - left - 1 <= max_gap))
    out = v.copy()
    if not len(row):
        return out
    n = seen.sum(1)
    order = np.argsort(~seen, 1, kind="stable")[:, : max(int(n.max()), 3)]
    known = np.arange(order.shape[1])[None, :] < n[:, None]
    last = np.take_along_axis(order, np.maximum(n - 1, 0)[:, None], 1)
    x = np.where(known, order, last).astype(float)
    y = np.where(known, np.take_along_axis(v, order, 1), 0.0)
    m = _curvatures(x, y, n)
    k = (np.cumsum(seen, 1) - 1)[row, day]
    a, b = left[row, day], right[row, day]
    h, up, down = (b - a).astype(float), (b - day).astype(float), (day - a).astype(float)
    ya, yb, ma, mb = y[row, k], y[row, k + 1], m[row, k], m[row, k + 1]
    curve = (ma * up**3 + mb * down**3) / (6 * h) + (ya / h - ma * h / 6) * up + (yb / h - mb * h / 6) * down
    out[row, day] = np.where(n[row] >= 4, curve, ya + (yb - ya) / h * down)
    return out


def impute_spline(obs: DataFrame, max_gap: int = 3) -> DataFrame:
    """Fills inner gaps of up to max_gap by a cubic through all observed days (at least 4, else the line of two neighbours).

    A series is a row with an array of its values by day; a task fills all series of a batch at once.
    """
    cells = F.sort_array(F.collect_list(F.struct("day", F.col("value").cast("double").alias("value"))))
    series = obs.groupBy(*SERIES).agg(cells.alias("cells")).select(*SERIES, F.col("cells.day").alias("days"), F.col("cells.value").alias("values"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("values")
            flat = np.asarray(values.flatten().fill_null(np.nan), float)
            sizes = pc.list_value_length(values).to_numpy()
            begins, done = np.cumsum(sizes) - sizes, flat.copy()
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                step = max(1, 1_000_000 // max(1, int(size)))
                for some in (rows[i : i + step] for i in range(0, len(rows), step)):
                    places = begins[some][:, None] + np.arange(size)
                    done[places] = _splined(flat[places], max_gap) if size > 2 else flat[places]
            offsets = pa.array(np.r_[begins, len(flat)], pa.int32())
            filled = pa.array((np.isnan(flat) & ~np.isnan(done)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, c) for c in (pa.array(done, mask=np.isnan(done)), filled)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*SERIES, "days")], *lists], names=[*SERIES, "days", "values", "imputed"])

    types = dict(obs.dtypes)
    schema = f"patient {types['patient']}, measure string, days array<{types['day']}>, values array<double>, imputed array<int>"
    filled = series.mapInArrow(fill, schema).select(*SERIES, F.inline(F.arrays_zip(F.col("days").alias("day"), F.col("values").alias("value"), "imputed")))
    return filled.withColumn("value", F.when(F.col("imputed") == 1, clipped(F.col("value"), F.col("measure"))).otherwise(F.col("value")))


def _solve(got: dict, features: int, target: int, ridge: float) -> np.ndarray:
    """Constant and slopes of a ridge regression from sums of products; slot 0 is the constant."""
    use = [0] + [i + 1 for i in range(features) if i != target]
    gram = np.array([[got[f"g{target}_{min(i, j)}_{max(i, j)}"] or 0.0 for j in use] for i in use])
    right = np.array([got[f"g{target}_{min(i, target + 1)}_{max(i, target + 1)}"] or 0.0 for i in use])
    return np.linalg.solve(gram + np.diag([1e-9] + [ridge] * (len(use) - 1)), right)


def _moments(got: dict[str, float], n: int, t: int) -> tuple[float, np.ndarray, float, np.ndarray, np.ndarray, float]:
    """Of measure t and the others, from a round's sums: rows, sums of the others, of t, and products among the others, with t, of t."""
    others = [i + 1 for i in range(n) if i != t]
    at = lambda i, j: float(got[f"g{t}_{min(i, j)}_{max(i, j)}"] or 0.0)
    xx = np.array([[at(i, j) for j in others] for i in others])
    return at(0, 0), np.array([at(0, i) for i in others]), at(0, t + 1), xx, np.array([at(i, t + 1) for i in others]), at(t + 1, t + 1)


def evidence_ridge(n: float, sx: np.ndarray, sy: float, xx: np.ndarray, xy: np.ndarray, yy: float, rounds: int = 300, tolerance: float = 1e-3, prior: float = 1e-6) -> np.ndarray:
    """The intercept and weights of a linear regression with Gaussian priors, from sums of products.

    The precision of the noise and that of the weights go to where the evidence is largest, in turn: of the eigenvalues of
    the centred products, those well above the ratio of the precisions are what the data determine. Gamma priors of shape
    and rate `prior` hold both; the turns end when the weights move by less than `tolerance` in all.
    """
    if not n:
        return np.zeros(1 + len(sx))
    mx, my = sx / n, sy / n
    xx, xy, yy = xx - n * np.outer(mx, mx), xy - n * mx * my, max(yy - n * my * my, 0.0)
    sizes, axes = np.linalg.eigh(xx)
    sizes = np.maximum(sizes, 0.0)
    noise_precision, weight_precision = 1.0 / (yy / n + np.finfo(float).eps), 1.0
    solved = lambda: axes @ ((axes.T @ xy) / (sizes + weight_precision / noise_precision))
    before = None
    for _ in range(rounds):
        weights = solved()
        left = max(float(yy - 2 * weights @ xy + weights @ xx @ weights), 0.0)
        known = float((noise_precision * sizes / (weight_precision + noise_precision * sizes)).sum())
        weight_precision = (known + 2 * prior) / (float(weights @ weights) + 2 * prior)
        noise_precision = (n - known + 2 * prior) / (left + 2 * prior)
        if before is not None and np.abs(weights - before).sum() < tolerance:
            break
        before = weights
    weights = solved()
    return np.r_[my - mx @ weights, weights]


def impute_chained(obs: DataFrame, measures: list[str], rounds: int = 10, ridge: float | None = None, seed: int | None = None) -> DataFrame:
    """Chained regressions: round after round each measure is predicted from the others at the same patient and day, where
    cells that are missing hold the guesses of the round before (at first the medians).

    Regressions are Bayesian ridges (see evidence_ridge), or ridges with the penalty `ridge`, if it is given.
    A round is one aggregate over a written table: all products that its regressions need, summed in Spark; the driver
    solves systems as large as the number of measures. Days before a series' first and after its last observation stay
    null, and measures without observations; there is no limit to a gap. seed: adds noise to filled cells.
    """
    wide = last_by_day(obs, measures)
    start = {r["measure"]: r["median"] for r in quantiles(obs.where(F.col("measure").isin(*measures)), ["measure"], "value", {"median": 0.5}).collect()}
    known = [m for m in measures if start.get(m) is not None]
    columns = [F.coalesce(F.col(f"`{m}`") - float(start[m]), F.lit(0.0)).alias(f"x{i}") for i, m in enumerate(known)]
    now = written(wide.select("patient", "day", *[F.col(f"`{m}`").isNotNull().alias(f"o{i}") for i, m in enumerate(known)], *columns))
    n = len(known)
    for _ in range(rounds if n > 1 else 0):
        slot = [F.lit(1.0), *[F.col(f"x{i}") for i in range(n)]]
        sums = [
            F.sum(F.when(F.col(f"o{t}"), slot[i] * slot[j])).alias(f"g{t}_{i}_{j}") for t in range(n) for i in range(n + 1) for j in range(i, n + 1)
        ]
        got = now.agg(*sums).first().asDict()
        guess = []
        for t in range(n):
            beta = _solve(got, n, t, ridge) if ridge is not None else evidence_ridge(*_moments(got, n, t))
            line = F.lit(float(beta[0]))
            for b, i in zip(beta[1:], [i for i in range(n) if i != t], strict=True):
                line = line + float(b) * F.col(f"x{i}")
            guess.append(F.when(F.col(f"o{t}"), F.col(f"x{t}")).otherwise(line).alias(f"x{t}"))
        now = written(now.select("patient", "day", *[f"o{i}" for i in range(n)], *guess))
    if not known:
        return obs.select(*SERIES, "day", "value", F.lit(0).alias("imputed"))
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), (F.col(f"x{i}") + float(start[m])).alias("guess")) for i, m in enumerate(known)])
    guesses = now.select("patient", "day", F.explode(cells).alias("c")).select("patient", "day", "c.measure", "c.guess")
    joined = neighbours(obs).join(guesses, ["patient", "day", "measure"], "left")
    noisy = F.col("guess") if seed is None else F.col("guess") + noise(seed)
    fill = F.col("value").isNull() & F.col("left_day").isNotNull() & F.col("right_day").isNotNull() & F.col("guess").isNotNull()
    return joined.select(*SERIES, "day", F.when(fill, clipped(noisy, F.col("measure"))).otherwise(F.col("value")).alias("value"), fill.cast("int").alias("imputed"))


def with_missingness(obs: DataFrame, measures: list[str], strategy: str | None = "linear_noise", max_gap: int = 2, seed: int | None = 42) -> DataFrame:
    """The entry point: fills gaps by a strategy (linear_noise, spline, mice, or None for none), then adds mask and delta.

    Cells that were filled count as observed in both, and have imputed = 1. Ends of a series stay null by any strategy.
    """
    if strategy is None:
        done = obs.withColumn("imputed", F.lit(0))
    elif strategy == "linear_noise":
        done = impute_linear(obs, max_gap, seed)
    elif strategy == "spline":
        done = impute_spline(obs, max_gap)
    elif strategy == "mice":
        done = impute_chained(obs, measures, seed=seed)
    else:
        raise ValueError(f"unknown strategy {strategy!r}: linear_noise, spline or mice")
    return mask_delta(done)
