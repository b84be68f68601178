"""Expected-calendar sources: hours, weekdays and weeks of a window."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measurekit.functions import times as T


def hour_spine(spark: SparkSession, start: dt.datetime, end: dt.datetime) -> DataFrame:
    hours = int((end - start).total_seconds() // 3600) + 1
    return spark.range(hours).select((F.lit(start).cast("timestamp_ntz") + T.hours(F.col("id").cast("int"))).alias("hour"))


def day_spine(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    return spark.range((end - start).days + 1).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("day"))


def weekday_spine(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    return day_spine(spark, start, end).where(~T.is_weekend(F.col("day")))


def week_spine(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """Weeks that hold a weekday of the window, by their Monday."""
    return weekday_spine(spark, start, end).select(T.week_start(F.col("day")).alias("week")).distinct()
