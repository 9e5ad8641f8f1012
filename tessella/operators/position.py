"""Where a patient stands: statistics by class, percentiles, class scores, nearest patients."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.shared import written

STATS = ["n", "mean", "median", "q10", "q25", "q75", "q90", "lowest", "highest"]


#: Rows and bytes of what is broadcast after counting.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64_000_000


def _width(df: DataFrame) -> Column:
    """Bytes of a row, about: what strings and arrays hold, and 16 for each column."""
    wide = [F.octet_length(c) for c, t in df.dtypes if t in ("string", "binary")]
    wide += [F.size(c) * 8 for c, t in df.dtypes if t.startswith("array<") and "struct" not in t and "string" not in t and "array" not in t[5:]]
    wide += [F.octet_length(F.to_json(F.struct(c))) for c, t in df.dtypes if t.startswith(("map<", "struct<")) or t.startswith("array<") and ("struct" in t or "string" in t or "array" in t[5:])]
    return sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(16 * len(df.columns)))


def if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast of df, if counting finds it to be of at most so many rows and BROADCAST_BYTES; else Spark chooses the join."""
    rows, size = df.limit(most + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(_width(df)), F.lit(0))).first()
    return F.broadcast(df) if rows <= most and size <= BROADCAST_BYTES else df


def query_blocks(queries: DataFrame, key: str) -> list[DataFrame]:
    """A stated set of queries as broadcasts, each within the bounds: one, if the set is."""
    rows, size = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(_width(queries)), F.lit(0))).first()
    n = max(1, -(-rows * 2 // BROADCAST_ROWS), -(-size * 2 // BROADCAST_BYTES)) if rows > BROADCAST_ROWS or size > BROADCAST_BYTES else 1
    return [F.broadcast(queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) if n > 1 else queries) for i in range(n)]


def cube(obs: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    """Nine statistics of each (measure, day, class); with a grid of these keys, empty cells are there with zeros.

    Quantiles are exact, and no task holds a cell's values. Ages, weights and the like are measures with a day of their own.
    """
    keys, seen = ["measure", "day", "class"], obs.where("value is not null")
    others = [F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("lowest"), F.max("value").alias("highest")]
    stats = summarized(seen, keys, "value", {"median": 0.5, "q10": 0.1, "q25": 0.25, "q75": 0.75, "q90": 0.9}, others).select(*keys, *STATS)
    if grid is None:
        return stats
    joined = grid.join(stats, keys, "left")
    return joined.select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in STATS])


def first_day_counts(obs: DataFrame) -> DataFrame:
    """How many patients of each class were first observed on each day."""
    first = obs.where("value is not null").groupBy("patient", "class").agg(F.min("day").alias("day"))
    return first.groupBy("class", "day").agg(F.count(F.lit(1)).alias("n"))


def percentiles(patients: DataFrame, base: DataFrame) -> DataFrame:
    """Share (in percent) of a class's values up to each patient's, by measure and day, with the distance to the median.

    patients: (patient, measure, day, value) of the patients asked about; base: the same of all, with class. A patient's
    values are ranked among those of each class, as rows that don't count themselves; no pairs are formed.
    """
    keys = ["measure", "day", "class"]
    seen = written(base.where("value is not null").select(*keys, "value"))
    totals = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    largest = totals.agg(F.max("total")).first()[0] or 0
    mine = patients.where("value is not null").select(F.col("patient").alias("query"), "measure", "day", F.col("value").alias("own"))
    mine = written(mine.join(totals, ["measure", "day"]))
    weighed = seen.select(*keys, "value", F.lit(1).alias("w")).unionByName(mine.select(*keys, F.col("own").alias("value"), F.lit(0).alias("w")))
    placed = ranges(weighed, keys, "value", weight="w", largest=largest).select(*keys, F.col("value").alias("own"), (F.col("start") + F.col("n")).alias("upto"))
    out = mine.join(placed, [*keys, "own"]).join(quantiles(seen, keys, "value", {"median": 0.5}, largest), keys)
    out = out.select("query", *keys, "own", (100 * F.col("upto") / F.col("total")).alias("percentile"), "median").distinct()
    far = F.when(F.col("median") != 0, F.abs(F.col("own") - F.col("median")) / F.greatest("median", F.lit(1e-6)))
    return out.withColumn("distance", far)


def class_scores(placed: DataFrame, alignment: DataFrame | None = None) -> DataFrame:
    """0.7 / (1 + mean distance) + 0.3 * alignment of each class for each patient asked about."""
    score = placed.groupBy("query", "class").agg(F.avg("distance").alias("mean_distance"), F.count("distance").alias("n"))
    if alignment is not None:
        score = score.join(alignment, ["query", "class"], "left")
    else:
        score = score.withColumn("alignment", F.lit(0.0))
    near = F.when(F.col("n") > 0, 0.7 / (1 + F.col("mean_distance"))).otherwise(0.0)
    return score.withColumn("score", near + 0.3 * F.coalesce("alignment", F.lit(0.0)))


def best_class(scores: DataFrame) -> DataFrame:
    """The class with the largest score of each patient; the first class wins ties."""
    return top(scores.withColumn("score", F.round("score", 9)), "query", [F.desc("score"), F.col("class")], 1).select("query", "class", "score")


def alignments(obs: DataFrame, patients: DataFrame) -> DataFrame:
    """Mean over a patient's positive measures of each class's positive rate, for each of `patients` (a column patient)."""
    per = obs.groupBy("class", "patient", "measure").agg(F.max(F.coalesce("value", F.lit(0.0)) > 0).alias("on"))
    own = per.where("on").join(patients.select("patient").distinct(), "patient", "left_semi").select(F.col("patient").alias("query"), "measure")
    rate = per.groupBy("class", "measure").agg(F.avg(F.col("on").cast("double")).alias("rate"))
    return own.join(F.broadcast(rate), "measure").groupBy("query", "class").agg(F.avg("rate").alias("alignment"))


def nearest(vectors: DataFrame, query: DataFrame, dims: list[str], k: int) -> DataFrame:
    """The k rows nearest to each query row by Euclidean distance over z-scores of the base; a null difference counts 0.

    Distances are rounded to six digits before they are ranked, so that equal ones go by patient.

    The base's means and deviations take one aggregate; queries meet the base where it is read, in blocks that
    are small enough to broadcast, and Spark limits each task's rows of a query to k before the shuffle.
    """
    moments = vectors.agg(*[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    z = lambda d, c: (F.col(c) - F.lit(moments[f"m_{d}"])) / (F.lit(moments[f"s_{d}"]) + 1e-9)
    mine = query.select(F.col("patient").alias("query"), *[F.col(d).alias(f"q_{d}") for d in dims])
    square = sum(F.coalesce((z(d, d) - z(d, f"q_{d}")) ** 2, F.lit(0.0)) for d in dims)
    pairs = reduce(DataFrame.unionByName, [vectors.join(q, F.col("patient") != F.col("query")).select("query", "patient", F.round(F.sqrt(square) + 1e-9, 6).alias("distance")) for q in query_blocks(mine, "query")])
    return top(pairs, "query", [F.col("distance"), F.col("patient")], k)


def top(df: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """First k rows of each key, with their rank from 1."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def label_counts(neighbours: DataFrame, labels: DataFrame, key: str = "patient", label: str = "class") -> DataFrame:
    """Labels of the neighbours of each query, counted."""
    return neighbours.join(labels.select(key, label), key).groupBy("query", label).agg(F.count(F.lit(1)).alias("n"))


#: Values of a group that one task ranks by itself; groups with more are ranked in ranges.
IN_TASK = 1_000_000


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0


def ranges(df: DataFrame, keys: list[str], value: str, blocks: int = 64, weight: str | None = None, largest: int | None = None) -> DataFrame:
    """(keys, value, n, start): each distinct value with its count (or sum of weights) and that of the smaller ones of its group.

    Where no group has more than IN_TASK rows (largest: as many as that of most has), each is ranked by one task. Otherwise values are cut into ranges at approximate quantiles, and a range's offset is
    a running sum over at most `blocks` ranges. The result is exact wherever the cuts lie. Nulls are left out.
    """
    tied = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    if (largest_group(df, keys) if largest is None else largest) <= IN_TASK:
        below = F.sum("n").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
        return tied.select(*keys, value, "n", F.coalesce(below, F.lit(0)).alias("start"))
    tied = written(tied)
    cuts = tied.groupBy(*keys).agg(F.percentile_approx(value, F.array(*[F.lit(i / blocks) for i in range(1, blocks)])).alias("cuts"))
    dealt = tied.join(if_small(written(cuts)), keys) if keys else tied.crossJoin(F.broadcast(cuts))
    dealt = dealt.withColumn("block", F.size(F.filter("cuts", lambda c: c <= F.col(value)))).drop("cuts")
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys, "block").agg(F.sum("n").alias("m")).withColumn("offset", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")
    inside = Window.partitionBy(*keys, "block").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    below = dealt.withColumn("below", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return below.join(starts, [*keys, "block"]).select(*keys, value, "n", (F.col("offset") + F.col("below")).alias("start"))


def summarized(df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], others: list[Column]) -> DataFrame:
    """Aggregates of each group beside exact quantiles of its values (null where it has none)."""
    largest = largest_group(df, keys)
    if largest <= IN_TASK:
        return df.groupBy(*keys).agg(*others, *[F.percentile(value, p).alias(n) for n, p in probabilities.items()])
    ends = quantiles(df, keys, value, probabilities, largest)
    whole = df.groupBy(*keys).agg(*others)
    return whole.join(ends, keys, "left") if keys else whole.join(F.broadcast(ends), how="left")


def quantiles(df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], largest: int | None = None) -> DataFrame:
    """Exact quantiles (linear between neighbours) of groups of any size, one column for each name. Groups without values have none."""
    seen = df.where(F.col(value).isNotNull())
    largest = largest_group(seen, keys) if largest is None else largest
    if 0 < largest <= IN_TASK:
        return seen.groupBy(*keys).agg(*[F.percentile(value, p).alias(n) for n, p in probabilities.items()])
    placed = written(ranges(df, keys, value, largest=largest))
    totals = placed.groupBy(*keys).agg(F.sum("n").alias("total"))
    joined = placed.join(totals, keys) if keys else placed.crossJoin(F.broadcast(totals))
    at = lambda rank: F.max(F.when((F.col("start") <= rank) & (rank < F.col("start") + F.col("n")), F.col(value)))
    place = {name: (F.col("total") - 1) * p for name, p in probabilities.items()}
    ends = joined.groupBy(*keys, "total").agg(*[f for name, x in place.items() for f in (at(F.floor(x)).alias(f"lo_{name}"), at(F.ceil(x)).alias(f"hi_{name}"))])
    line = [(F.col(f"lo_{n}") + (F.col(f"hi_{n}") - F.col(f"lo_{n}")) * (x - F.floor(x))).alias(n) for n, x in place.items()]
    return ends.select(*keys, *line)


def thinned_values(df: DataFrame, keys: list[str], value: str, most: int = 100) -> DataFrame:
    """(keys, place, value): `most` evenly spaced values, in order, of each group that has more."""
    placed = ranges(df, keys, value)
    totals = placed.groupBy(*keys).agg(F.sum("n").alias("total")).where(F.col("total") > most)
    rank = lambda i: F.floor(i * (F.col("total") - 1) / F.lit(most - 1))
    places = F.filter(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: (rank(i) >= F.col("start")) & (rank(i) < F.col("start") + F.col("n")))
    return placed.join(totals, keys).select(*keys, F.explode(places).alias("place"), value)
