"""Cohort analytics: statistics of measures by day, presence rates, counts of values, filters from questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import constants as C
from tessella.functions import text as X

from .position import if_small, summarized


def moments(value: str) -> list[Column]:
    """Count, mean, sample deviation, ends."""
    c = F.col(value)
    return [F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).alias("lowest"), F.max(c).alias("highest")]


def long_form(wide: DataFrame, key: str, columns: dict[str, tuple[str, int]]) -> DataFrame:
    """(key, measure, day, value) from one column for each measure and day; NaN becomes null."""
    cells = [F.struct(F.lit(m).alias("measure"), F.lit(d).alias("day"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("value")) for c, (m, d) in columns.items()]
    return wide.select(key, F.explode(F.array(*cells)).alias("cell")).select(key, "cell.measure", "cell.day", "cell.value")


def daily_stats(obs: DataFrame) -> DataFrame:
    """Statistics of each measure and day with the share of patients observed and how far to trust them."""
    keys = ["measure", "day"]
    out = summarized(obs, keys, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, [*moments("value"), F.count(F.lit(1)).alias("total")])
    return out.withColumn("coverage", F.col("n") / F.col("total")).withColumn("trust", X.trust(F.col("n") / F.col("total")))


def presence(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Two rules of presence: a value is there, or it is above 0."""
    positive = F.coalesce(F.col("value"), F.lit(0.0)) > 0
    return obs.groupBy(*keys).agg(
        F.count("value").alias("n_present"),
        F.count_if(positive).alias("n_positive"),
        (F.count("value") / F.count(F.lit(1))).alias("present_rate"),
        F.avg(positive.cast("double")).alias("positive_rate"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Each value with its count and share; null is a value."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("total")).alias("rate"))


def token_counts(df: DataFrame, cell: Column) -> DataFrame:
    """Values of multi-valued cells, counted, with their share of all rows."""
    tokens = df.select(F.explode(X.parts(cell)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return tokens.crossJoin(F.broadcast(total)).select("token", "n", (F.col("n") / F.col("total")).alias("rate"))


def before_after(df: DataFrame, cell: Column, names: dict[str, str]) -> DataFrame:
    """Counts of each value before and after cleaning."""
    before = df.select(F.explode(X.parts(cell)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("before"))
    after = df.select(F.explode(X.parts(X.clean_cell(cell, names))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("after"))
    return before.join(after, "token", "full").select("token", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


def matching(df: DataFrame, filters: dict[str, object]) -> DataFrame:
    """Rows that agree with all filters: text without regard to case, numbers as numbers; unknown columns are skipped."""
    for name, value in filters.items():
        if name not in df.columns:
            continue
        if isinstance(value, str):
            df = df.where(F.lower(F.col(name).cast("string")) == value.lower())
        else:
            df = df.where(F.col(name).try_cast("double") == float(value))
    return df


def most_common(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k values that most rows have, with their count; the first of equals by value. Null isn't one."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def class_counts(df: DataFrame, label: str, classes: DataFrame) -> DataFrame:
    """Rows of each class of `classes` (a small table with the column label), those without rows too."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return if_small(classes).join(counts, label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n"))


def severity(c: Column, severe: str, warning: str) -> Column:
    """2, 1 or 0 by what a note mentions; null stays null."""
    low = F.lower(F.trim(c))
    return F.when(c.isNotNull(), F.when(low.rlike(severe), 2).when(low.rlike(warning), 1).otherwise(0))


def note_severity(c: Column) -> Column:
    """2 for a note on a severe state, 1 for one to watch, 0 for any other; null stays null."""
    note = F.lower(F.trim(c))
    held = lambda parts: note.rlike("|".join(parts))
    return F.when(note.isNotNull(), F.when(held(C.SEVERE_NOTES), 2).when(held(C.WATCHED_NOTES), 1).otherwise(0))



def routed(question: Column, rules: list[tuple[str, str]]) -> Column:
    """The intent of a question: that of the first rule (pattern, intent) that matches."""
    low, out = F.lower(F.trim(question)), None
    for pattern, intent in rules:
        out = F.when(low.rlike(pattern), intent) if out is None else out.when(low.rlike(pattern), intent)
    return out
