"""Role mapping: the supplied `events` table read as verbatim weighing rows and as hourly context observations.

No row of `events` is left out. Faults (repeats, bad weights and times, wrong clocks, gaps) are written into the rows by rules
on `event_id`, so that every operator meets them at any table size.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measurekit.config import Config, Threshold, TimeOverride
from measurekit.functions import times as T

PRIMARY, OTHER = "primary", "secondary"
PARAMETERS = ("purchase", "signup", "view", "click", "error")
SHIFTED_FILE = "primary_2024-01-08.csv"

CONFIG = Config(
    populations=(("primary_", PRIMARY), ("secondary_", OTHER)),
    primary=PRIMARY,
    other=OTHER,
    zone="Europe/Helsinki",
    window=(dt.date(2024, 1, 2), dt.date(2024, 1, 29)),
    context_window=(dt.datetime(2024, 1, 2, 8), dt.datetime(2024, 1, 29, 12)),
    context_station="100",
    context_parameters=PARAMETERS,
    overrides=(TimeOverride(SHIFTED_FILE, "NORMALISED_PLUS_3H", 3, "aligned with the other files of the population",
                            dt.date(2024, 1, 8), dt.date(2024, 1, 14), (7.0, 8.5)),),
    scale_kinds=(("lammin", "hot (lammin)"), ("salaatti", "cold (salaatti)")), hot_kind="lammin", twin_sides=("vasen", "oikea"),
    session_span=Threshold(">", 7200),
    day_minimum=45,
    weekday_regime={"Monday": "high", "Tuesday": "high", "Wednesday": "high", "Thursday": "low", "Friday": "low"},
    baseline=(dt.date(2024, 1, 1), dt.date(2024, 1, 14)),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Share rows out where the source gives fewer splits than there are cores (few row groups); otherwise leave the splits alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def _local(ts):
    """A 24 h day squeezed into 10:00-14:00, so that every event falls into service hours."""
    second_of_day = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts)).cast("int")
    return ts.cast("date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(10), secs=F.floor(second_of_day / 6))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbatim rows as a delimited file would hold them: text cells plus file name and row number."""
    i = F.col("event_id")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    is_primary = F.col("event_type").isin("purchase", "signup", "view") | (F.col("ts") >= F.lit("2024-01-22").cast("timestamp_ntz"))
    wall = F.col("true_local") - F.when(F.col("source_file") == SHIFTED_FILE, T.hours(3)).otherwise(T.hours(0))
    day = F.col("true_local").cast("date").cast("timestamp_ntz")
    ident = (day + F.make_dt_interval(hours=F.lit(13), mins=F.lit(50),
                                      secs=(F.col("user_id") % 5 - 1) * 30 + F.when(i % 307 == 0, 1).otherwise(0))
             - F.when(F.col("source_file") == SHIFTED_FILE, T.hours(3)).otherwise(T.hours(0)))

    def text(t):
        return F.when(i % 5 == 0, F.replace(t.cast("string"), F.lit("-"), F.lit("."))).otherwise(t.cast("string"))

    dish = (i % 60).cast("string")
    return (
        spread(table(spark, sf_dir, "events"), "event_id")
        .withColumn("true_local", _local(F.col("ts")) + F.when(i % 503 == 0, T.hours(6)).otherwise(T.hours(0)))
        .withColumn("source_file", F.concat(F.when(is_primary, "primary_").otherwise("secondary_"),
                                            T.week_start(F.col("ts").cast("date")).cast("string"), F.lit(".csv")))
        # one in a hundred rows is written twice, cell for cell, right behind the first copy
        .withColumn("copy", F.explode(F.when(i % 100 == 7, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select(
            "source_file",
            (i * 2 + F.col("copy") + 1).alias("source_row_number"),
            F.concat_ws("-", F.col("user_id").cast("string"), F.col("ts").cast("date").cast("string")).alias("session_id"),
            F.when(i % 409 == 0, F.concat(text(wall), F.lit(".5"))).otherwise(text(wall)).alias("weighing_event_time"),
            F.when(F.startswith("source_file", F.lit("primary_")), "line").alias("weighting_type"),
            F.concat(F.lit("st"), (k % 3).cast("string"), F.lit("-"),
                     F.when(k % 7 == 0, "").when(k % 2 == 0, "vasen-").otherwise("oikea-"),
                     F.when(k % 5 < 2, "lammin").otherwise("salaatti"), (k % 6).cast("string")).alias("scale_identifier"),
            F.when(i % 97 == 0, "").when(i % 101 == 0, "x1")
            .otherwise(F.floor(F.col("value") * 10).cast("bigint").cast("string")).alias("weight_of_a_component"),
            F.when(i % 499 == 0, " ").when(i % 7 == 0, F.concat(F.lit("  DISH  "), dish, F.lit(" ")))
            .otherwise(F.concat(F.lit("dish "), dish)).alias("component_name"),
            F.concat(F.lit("tray"), (F.col("user_id") % 50).cast("string"), F.when(i % 211 == 0, "b").otherwise("")).alias("tray_id"),
            F.when(i % 401 == 0, "n/a").otherwise(text(ident)).alias("user_identification_time"),
            # what the file reader would say of rows with a cell under a blank header, too few cells, or a column nobody declared
            F.when(i % 601 == 0, "EXTRA_CELLS").when(i % 607 == 0, "SHORT_ROW").otherwise("OK").alias("row_status"),
            F.when(i % 601 == 0, '{"blank_header_columns":{"9":"hidden"}}').when(i % 613 == 0, '{"extra_columns":{"note":"kept"}}').alias("unmapped"),
        )
    )


def raw_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly context in long form, one row per (UTC hour, parameter): the mean event value of the hour.

    On some days the sensor clock stood still, so hours 9 and 10 were booked to hour 8 (and `signup` of hour 11 to hour 12):
    those hours are missing without any event being lost.
    """
    local = _local(F.col("ts"))
    utc = T.utc_candidate(local, CONFIG.zone)
    hour = T.ceil_hour(utc)
    booked = (F.when((F.dayofmonth(hour) % 7 == 3) & F.hour(hour).isin(9, 10), hour.cast("date").cast("timestamp_ntz") + T.hours(8))
              .when((F.dayofmonth(hour) % 5 == 0) & (F.hour(hour) == 11) & (F.col("event_type") == "signup"), hour + T.hours(1))
              .otherwise(hour))
    grams = F.floor(F.col("value") * 10).cast("bigint")
    mark = F.col("first_id")
    return (
        table(spark, sf_dir, "events")
        .select(booked.alias("hour"), F.col("event_type").alias("parameter"), grams.alias("g"), "event_id")
        .groupBy("hour", "parameter")
        .agg(F.sum("g").alias("total"), F.count("*").alias("n"), F.min("event_id").alias("first_id"))
        .select(
            F.concat_ws("/", F.col("parameter"), F.col("hour").cast("string")).alias("observation_id"),
            F.concat(F.lit("context_"), T.week_start(F.col("hour").cast("date")).cast("string"), F.lit(".xml")).alias("source_file"),
            F.lit(CONFIG.context_station).alias("station"),
            F.concat(F.replace(F.col("hour").cast("string"), F.lit(" "), F.lit("T")), F.lit("Z")).alias("time_raw"),
            "parameter",
            F.when(mark % 61 == 0, "NaN").when(mark % 53 == 0, "bad")
            .otherwise(F.floor(F.col("total") / F.col("n")).cast("bigint").cast("string")).alias("value_raw"),
        )
    )
