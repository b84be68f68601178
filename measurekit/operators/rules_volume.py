"""Volume and coverage per day and population. Flags only: no day is ever left out because of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from measurekit.config import Config
from measurekit.functions import times as T
from measurekit.operators.facts import with_regime
from measurekit.operators.rules_events import finding, inline_findings


def service_days(sessions: DataFrame, cfg: Config) -> DataFrame:
    """Validation's day table: sessions not quarantined, per population and day of the first counted event."""
    c = F.col
    days = (sessions.where(~c("is_quarantined") & c("first_counted_local").isNotNull())
            .groupBy("population", c("first_counted_local").cast("date").alias("service_date"))
            .agg(F.count("*").alias("sessions")))
    return with_regime(days, c("service_date"), cfg)


def baseline_regimes(days: DataFrame, cfg: Config) -> DataFrame:
    """Weekday -> regime seen in the baseline weeks; 'mixed' where the weeks disagree."""
    c = F.col
    start, end = cfg.baseline
    return (days.where((c("population") == cfg.primary) & c("service_date").between(F.lit(start), F.lit(end)))
            .groupBy("weekday")
            .agg(F.when(F.min("observed_regime") == F.max("observed_regime"), F.max("observed_regime")).otherwise("mixed").alias("regime")))


def volume_findings(days: DataFrame, cfg: Config) -> DataFrame:
    c = F.col
    counted = F.concat(c("sessions").cast("string"), F.lit(" sessions"))

    def one(rule: str, when: str, observed, expected) -> object:
        return finding(rule, c(when), "service_day", c("service_date").cast("string"), observed, expected,
                       "the day is kept", "SERVICE_DAY", population=c("population"))

    return inline_findings(days, [
        one("C02a", "low_volume_day", counted, f">= {cfg.day_minimum} sessions"),
        one("C02b", "volume_irregularity", F.concat_ws(", ", "observed_regime", counted),
            F.concat(c("expected_regime"), F.lit(" regime on "), c("weekday"))),
    ])


def expected_days(days: DataFrame, cfg: Config) -> DataFrame:
    """The weekdays of the window, for each population seen."""
    start, end = (F.lit(d) for d in cfg.window)
    spine = days.select("population").distinct().select("population", F.explode(F.sequence(start, end)).alias("day"))
    return spine.where(~T.is_weekend(F.col("day")))


def missing_weekdays(days: DataFrame, cfg: Config) -> DataFrame:
    """Weekdays of the window without a session, per population seen."""
    expected = expected_days(days, cfg)
    seen = days.select("population", F.col("service_date").alias("day"))
    return expected.join(seen, ["population", "day"], "left_anti")


def missing_weeks(days: DataFrame, cfg: Config) -> DataFrame:
    expected = expected_days(days, cfg).select("population", T.week_start(F.col("day")).alias("week")).distinct()
    seen = days.select("population", T.week_start(F.col("service_date")).alias("week"))
    return expected.join(seen, ["population", "week"], "left_anti")


def coverage_findings(days: DataFrame, cfg: Config) -> DataFrame:
    """C01 missing weekdays per population, C03 whole weeks without data."""
    c = F.col
    gaps = (missing_weekdays(days, cfg).groupBy("population")
            .agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last")))
    c01 = inline_findings(gaps, [finding(
        "C01", F.lit(True), "population", c("population"), F.format_string("missing: %s..%s (%d days)", c("first").cast("string"), c("last").cast("string"), c("n")),
        "every weekday of the window", "weekdays without a session", "POPULATION", population=c("population"))])
    c03 = inline_findings(missing_weeks(days, cfg), [finding(
        "C03", F.lit(True), "population_week", F.concat_ws("|", "population", c("week").cast("string")), F.lit("0 sessions"),
        "data for every week of the window", "a week without data", "ABSENT_SOURCE", population=c("population"))])
    return c01.unionByName(c03)
