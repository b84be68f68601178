"""Structure of the hourly context: grain, coverage as ranges, completeness per parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from measurekit.config import Config
from measurekit.functions import times as T
from measurekit.operators.rules_events import finding, inline_findings
from measurekit.sources.calendar import hour_spine


def hour_ranges(hours: DataFrame, partition: list[str]) -> DataFrame:
    """Contiguous ranges of hours: start, end, length. Hours are distinct, so a range is constant in hour minus rank.

    Inside a window of `partition` the rows are calendar hours (24 a day), never events.
    """
    w = Window.partitionBy(*partition).orderBy("hour")
    island = F.col("hour") - T.hours(F.row_number().over(w))
    return (hours.withColumn("island", island).groupBy(*partition, "island")
            .agg(F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"), F.count("*").alias("hours"))
            .drop("island"))


def coverage_gaps(observations: DataFrame, cfg: Config) -> DataFrame:
    """Hours of the window without any observation, and observed hours outside the expected ones, as ranges."""
    expected = hour_spine(observations.sparkSession, *cfg.context_window)
    seen = observations.where(F.col("obs_utc").isNotNull()).select(F.col("obs_utc").alias("hour")).distinct()
    missing = expected.join(seen, "hour", "left_anti").withColumn("kind", F.lit("missing"))
    unexpected = seen.join(expected, "hour", "left_anti").withColumn("kind", F.lit("unexpected"))
    return hour_ranges(missing.unionByName(unexpected), ["kind"])


def missing_parameters(observations: DataFrame, cfg: Config) -> DataFrame:
    """Expected and observed hours that lack a requested parameter."""
    spark = observations.sparkSession
    seen = observations.where(F.col("obs_utc").isNotNull()).select(F.col("obs_utc").alias("hour"), "parameter").distinct()
    present = hour_spine(spark, *cfg.context_window).join(seen.select("hour").distinct(), "hour", "left_semi")
    wanted = present.select("hour", F.explode(F.array(*[F.lit(p) for p in cfg.context_parameters])).alias("parameter"))
    return wanted.join(seen, ["hour", "parameter"], "left_anti")


def context_findings(observations: DataFrame, cfg: Config) -> DataFrame:
    """X01, X03, X07 and X08."""
    c = F.col

    def one(rule: str, when: Column, observed: Column, expected: str, description: str, suffix: str = "") -> Column:
        entity = F.concat(c("observation_id"), F.lit(f"|{suffix}")) if suffix else c("observation_id")
        return finding(rule, F.coalesce(when, F.lit(False)), "context_observation", entity, observed, expected, description,
                       "CONTEXT_ROW", source_file=c("source_file"))

    grain = (observations.where(c("obs_utc").isNotNull()).groupBy("obs_utc", "parameter").agg(F.count("*").alias("grain_rows"))
             .where("grain_rows > 1"))
    rows = observations.join(grain, ["obs_utc", "parameter"], "left")
    per_row = inline_findings(rows, [
        one("X07", c("station") != cfg.context_station, c("station"), cfg.context_station, "another station", "station"),
        one("X07", c("obs_utc").isNull(), c("time_raw"), "yyyy-MM-ddTHH:mm:ssZ", "no UTC time", "time"),
        one("X07", T.floor_hour(c("obs_utc")) != c("obs_utc"), c("time_raw"), "an hourly time", "not on the hour", "hour"),
        one("X07", ~c("parameter").isin(*cfg.context_parameters), c("parameter"), ",".join(cfg.context_parameters), "unrequested parameter", "parameter"),
        one("X07", c("value_status") == "UNPARSEABLE", c("value_raw"), "a number or NaN", "no number", "value"),
        one("X07", c("grain_rows") > 1, F.concat(c("grain_rows").cast("string"), F.lit(" rows")), "one row", "grain not unique", "grain"),
        one("X03", c("value_status") == "NAN_SOURCE_NULL", c("value_raw"), "a number", "NaN kept as NULL, never zero"),
    ])
    span = F.concat_ws("..", T.iso_text(c("first_hour")), T.iso_text(c("last_hour")))
    x01 = inline_findings(coverage_gaps(observations, cfg), [finding(
        "X01", F.lit(True), "context_hours", F.concat_ws(" ", "kind", span), F.concat(c("hours").cast("string"), F.lit(" hours")),
        "every hour of the window", "hours missing or unexpected", "ABSENT_SOURCE")])
    lacking = (missing_parameters(observations, cfg).groupBy("parameter")
               .agg(F.count("*").alias("hours"), F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour")))
    x08 = inline_findings(lacking, [finding(
        "X08", F.lit(True), "context_parameter", c("parameter"), F.format_string("%d hours, %s", c("hours"), span),
        "every requested parameter each hour", "hours without the parameter", "ABSENT_SOURCE")])
    return per_row.unionByName(x01).unionByName(x08)


def completeness(observations: DataFrame, declared: DataFrame, cfg: Config) -> DataFrame:
    """Per file: declared and parsed rows, parameters, distinct hours, duplicate (time, parameter), and the first reason that fails."""
    c = F.col
    start, end = cfg.context_window
    wanted = F.array(*[F.lit(p) for p in sorted(cfg.context_parameters)])
    per_file = observations.groupBy("source_file").agg(
        F.count("*").alias("parsed_rows"), F.count_distinct("obs_utc", "parameter").alias("distinct_grain"),
        F.count_distinct("obs_utc").alias("hours"), F.array_sort(F.collect_set("parameter")).alias("parameters"),
        F.min("obs_utc").alias("first_hour"), F.max("obs_utc").alias("last_hour"))
    joined = declared.join(per_file, "source_file", "left")
    reason = (F.when(c("parsed_rows").isNull(), "MISSING")
              .when(c("declared_rows") != c("parsed_rows"), "DECLARED_COUNT")
              .when(~c("parameters").eqNullSafe(wanted), "PARAMETERS")
              .when(c("distinct_grain") < c("parsed_rows"), "DUPLICATES")
              .when(c("distinct_grain") != c("hours") * len(cfg.context_parameters), "INCOMPLETE_GRID")
              .when((c("first_hour") < F.lit(start).cast("timestamp_ntz")) | (c("last_hour") > F.lit(end).cast("timestamp_ntz")), "OUTSIDE_WINDOW")
              .otherwise("OK"))
    return joined.select("source_file", "declared_rows", "parsed_rows", "distinct_grain", "hours",
                         F.array_join("parameters", ";").alias("parameters"), T.iso_text(c("first_hour")).alias("first_hour"),
                         T.iso_text(c("last_hour")).alias("last_hour"), reason.alias("status"))


def convention_mae(hourly: DataFrame, slots: DataFrame) -> DataFrame:
    """Does an hourly total cover the hour ending or starting at its time? Mean absolute error of both against six 10-minute slots.

    `hourly(hour, total)` and `slots(t, amount)`; hours without six slots on both sides are left out.
    """
    c = F.col
    end = slots.groupBy(T.ceil_hour(c("t")).alias("hour")).agg(F.count("amount").alias("n_end"), F.sum("amount").alias("ending"))
    start = slots.groupBy(T.floor_hour(c("t")).alias("hour")).agg(F.count("amount").alias("n_start"), F.sum("amount").alias("starting"))
    joined = hourly.join(end, "hour").join(start, "hour").where("n_end = 6 and n_start = 6 and total is not null")
    return joined.agg(F.count("*").alias("hours"), F.avg(F.abs(c("total") - c("ending"))).alias("mae_ending"),
                      F.avg(F.abs(c("total") - c("starting"))).alias("mae_starting"))
