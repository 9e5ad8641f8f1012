"""Structured Streaming forms of two operators, an extension: the batch operators are the reference for their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Mean and count of each measure and day, final once the watermark has passed the day."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))


def latest(events: DataFrame) -> DataFrame:
    """The latest value of each user and measure so far (update mode)."""
    return events.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("ts"))
