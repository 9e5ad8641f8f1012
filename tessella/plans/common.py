"""Views that several queries start from, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import series
from tessella.sources.files import read_table as table

MEASURES = ["click", "error", "purchase", "signup", "view"]


def last_day(spark: SparkSession, sf_dir: str) -> int:
    """Days from the first event of the table to the last, both counted."""
    ends = table(spark, sf_dir, "events").agg(F.date_diff(F.max("ts"), F.min("ts"))).first()
    return (ends[0] or 0) + 1


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as daily means of each user and type: patient, measure, day (1 is that of the table's first event; every day up
    to its last has a row), value."""
    events = table(spark, sf_dir, "events")
    first, last = events.agg(F.min("ts")).first()[0], last_day(spark, sf_dir)
    cells = events.groupBy(F.col("user_id").alias("patient"), F.col("event_type").alias("measure"), (F.date_diff("ts", F.lit(first)) + 1).alias("day"))
    return series.dense(cells.agg(F.round(F.avg("value"), 6).alias("value")), 1, last)


def classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs(spark, sf_dir).withColumn("class", (1 + F.col("patient") % 3).cast("int"))


OBS = """cells AS (SELECT user_id AS patient, event_type AS measure, CAST(date_diff('day', (SELECT min(ts) FROM events), ts) + 1 AS INT) AS day, round(avg(value), 6) AS value
  FROM events GROUP BY ALL),
days AS (SELECT unnest(range(1, (SELECT max(day) FROM cells) + 1)) AS day),
obs AS (SELECT s.patient, s.measure, CAST(d.day AS INT) AS day, c.value FROM (SELECT DISTINCT patient, measure FROM cells) s
  CROSS JOIN days d LEFT JOIN cells c ON c.patient = s.patient AND c.measure = s.measure AND c.day = d.day)"""
CLASSED = OBS + ", base AS (SELECT *, CAST(1 + patient % 3 AS INT) AS class FROM obs)"
FILLED = (
    OBS
    + """, near AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN day END IGNORE NULLS) OVER p AS ld, last_value(value IGNORE NULLS) OVER p AS lv,
  first_value(CASE WHEN value IS NOT NULL THEN day END IGNORE NULLS) OVER n AS rd, first_value(value IGNORE NULLS) OVER n AS rv FROM obs
  WINDOW p AS (PARTITION BY patient, measure ORDER BY day ROWS UNBOUNDED PRECEDING),
  n AS (PARTITION BY patient, measure ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT patient, measure, day, CASE WHEN fill THEN lv + (rv - lv) * (day - ld) / (rd - ld) ELSE value END AS value,
  CAST(coalesce(fill, false) AS INT) AS imputed FROM (SELECT *, value IS NULL AND rd - ld - 1 BETWEEN 1 AND 2 AS fill FROM near))"""
)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many places, since sums differ in their last bits by the order of rows; 1e-9 settles what is halfway."""
    return df.select(*[F.round(F.col(c) + 1e-9, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
