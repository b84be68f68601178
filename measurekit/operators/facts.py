"""Canonical tables: event, session, session-component, context hour and daily volume.

Two event sets, on purpose: weights, components and counts use MODELLABLE events; times and identity use every row that is not
an excluded repeat. Quarantine is decided per session, so a session is either wholly modellable (repeats aside) or not at all,
and the session fact follows from the profile aggregate without a second pass over the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from measurekit.config import Config
from measurekit.functions import stats as S
from measurekit.functions import text as X
from measurekit.functions import times as T
from measurekit.operators.rules_events import EVENT_RULES

MODELLABLE, REPEAT, QUARANTINED = "MODELLABLE", "DUPLICATE_EXCLUDED", "QUARANTINED"


def with_disposition(flagged: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every event gets exactly one disposition; quarantine wins over repeat."""
    q = sessions.where("is_quarantined").select("session_key", F.lit(True).alias("in_quarantine"))
    return (flagged.join(q, "session_key", "left")
            .withColumn("disposition", F.when(F.col("in_quarantine"), QUARANTINED).when(F.col("is_repeat"), REPEAT).otherwise(MODELLABLE))
            .drop("in_quarantine"))


def event_rule_ids(cfg: Config, severity: str) -> Column:
    """Rule ids of one severity that fired on the event, as a sorted `;` list."""
    fired = [F.when(F.col(f"hit_{r}"), F.lit(r)) for r in sorted(EVENT_RULES) if cfg.catalogue[r].severity == severity]
    return F.array_join(F.array_compact(F.array(*fired)), ";") if fired else F.lit("")


def with_event_status(disposed: DataFrame, cfg: Config) -> DataFrame:
    return disposed.withColumns({f"{s.lower()}_rule_ids": event_rule_ids(cfg, s) for s in ("ERROR", "WARN", "INFO")})


def quality(errors: Column, warns: Column, quarantined: Column) -> Column:
    return F.when((errors != "") | quarantined, "INVALID").when(warns != "", "WARN").otherwise("VALID")


def fact_event(disposed: DataFrame, sessions: DataFrame, cfg: Config) -> DataFrame:
    """One canonical row per staged event; nothing is removed, the disposition says what a row may be used for."""
    reasons = sessions.where("is_quarantined").select("session_key", "quarantine_rule_ids")
    status = with_event_status(disposed, cfg).join(reasons, "session_key", "left")
    blank = F.lit("")
    return status.select(
        "event_id", "source_snapshot_id", "source_file", "source_row_number", "row_sha256", "population", "session_id", "session_key",
        "tray_id", "scale_id", X.station_family(F.col("scale_id")).alias("station_family"), "scale_kind", "component_raw", "component",
        "weight_raw", "weight_g", "weight_status", "weighing_type", "event_time_raw", "event_local", "event_utc", "event_time_status",
        "ident_time_raw", "ident_local", "ident_utc", "ident_time_status", "tz_handling", "tz_offset_hours", "tz_reason", "disposition",
        (F.col("disposition") == MODELLABLE).alias("is_modellable"),
        F.col("is_repeat").alias("is_exact_duplicate"),
        F.nullif("quarantine_rule_ids", blank).alias("quarantine_rule_ids"),
        quality(F.col("error_rule_ids"), F.col("warn_rule_ids"), F.col("disposition") == QUARANTINED).alias("quality_status"),
        F.nullif("error_rule_ids", blank).alias("error_rule_ids"), F.nullif("warn_rule_ids", blank).alias("warn_rule_ids"),
        F.nullif("info_rule_ids", blank).alias("info_rule_ids"),
    )


def name_cells(staged: DataFrame) -> DataFrame:
    """(scale, local date, component) with the populations it was seen in: the base of every name comparison, no sets needed."""
    return (staged.where(F.col("event_local").isNotNull() & F.col("component").isNotNull())
            .groupBy("scale_id", F.col("event_local").cast("date").alias("day"), "component")
            .agg(F.min("population").alias("lo"), F.max("population").alias("hi")))


def scale_day_agreement(cells: DataFrame) -> DataFrame:
    """Scale-days seen in both populations: names in each, shared names, Jaccard, identical, disjoint."""
    shared = F.col("lo") != F.col("hi")
    grouped = (cells.groupBy("scale_id", "day")
               .agg(F.count("*").alias("names"), F.count_if(shared).alias("shared"),
                    F.min("lo").alias("lo"), F.max("hi").alias("hi"))
               .where("lo <> hi"))
    return grouped.select("scale_id", "day", "names", "shared",
                          (F.col("shared") / F.col("names")).alias("jaccard"),
                          (F.col("shared") == F.col("names")).alias("identical"), (F.col("shared") == 0).alias("disjoint"))


def limited_sessions(disposed: DataFrame, agreement: DataFrame) -> DataFrame:
    """Session keys with a modellable event on a scale-day whose populations share no name."""
    cells = agreement.where("disjoint").select("scale_id", "day")
    events = disposed.where(F.col("disposition") == MODELLABLE).select(
        "session_key", "scale_id", F.col("event_local").cast("date").alias("day"))
    return events.join(cells, ["scale_id", "day"], "left_semi").select("session_key").distinct()


def fact_session(sessions: DataFrame, cfg: Config, limited: DataFrame | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """The canonical session row, from the profile aggregate. NULL business fields where quarantined, never zero.

    `extra` names columns of `sessions` to carry along.
    """
    q = F.col("is_quarantined")
    live = ~q
    modellable = F.when(q, 0).otherwise(F.col("events_counted"))
    weight = F.when(live, F.col("weight_counted"))
    primary = F.col("population") == cfg.primary
    errors, warns, infos = F.col("error_rule_ids"), F.col("warn_rule_ids"), F.col("info_rule_ids")
    ready = primary & live & (modellable > 0) & (errors == "") & weight.isNotNull() & F.col("first_utc").isNotNull()
    df = sessions
    if limited is not None:
        df = df.join(limited.withColumn("in_limited", F.lit(True)), "session_key", "left")
    status = (F.when(F.coalesce(F.col("in_limited"), F.lit(False)), "LIMITED").otherwise("READY_WITH_LIMITATION")
              if limited is not None else F.lit("NOT_COMPARED"))
    blank = F.lit("")
    return df.select(
        "session_key", "session_id", "population", primary.alias("is_primary_population"), "source_snapshot_id", "source_files",
        F.col("tray_single").alias("tray_id"), F.col("first_local").cast("date").alias("service_date"),
        F.col("first_local").alias("first_weighing_local"), F.col("first_utc").alias("first_weighing_utc"),
        F.col("last_local").alias("last_weighing_local"), F.col("last_utc").alias("last_weighing_utc"),
        F.col("ident_single_local").alias("identification_local"), F.col("ident_single_utc").alias("identification_utc"),
        "span_s", F.round(F.col("span_s") / 60, 6).alias("duration_minutes"),
        F.col("events_staged").alias("event_count"), modellable.alias("modellable_event_count"),
        F.when(q, 0).otherwise(F.col("repeats")).alias("duplicate_excluded_event_count"),
        F.when(q, F.col("events_staged")).otherwise(0).alias("quarantined_event_count"),
        weight.alias("selected_weight_g"),
        F.when(live & (modellable > 0), F.col("n_components")).alias("distinct_component_count"),
        F.when(live & (modellable > 0), F.col("n_raw_components")).alias("distinct_raw_component_count"),
        status.alias("component_count_status"), F.col("in_both_populations").alias("identity_conflict"), "is_quarantined",
        F.nullif("quarantine_rule_ids", blank).alias("quarantine_rule_ids"), ready.alias("core_ready"),
        F.when(errors != "", "ERROR").when(warns != "", "WARN").when(infos != "", "INFO").otherwise("NONE").alias("max_severity"),
        F.nullif("error_rule_ids", blank).alias("error_rule_ids"), F.nullif("warn_rule_ids", blank).alias("warn_rule_ids"),
        "has_session_warn", "has_event_warn", quality(errors, warns, q).alias("quality_status"), *extra,
    )


def fact_component(disposed: DataFrame) -> DataFrame:
    """One row per distinct component of a session, from modellable events. Events behind a row: join on session and component."""
    c = F.col
    return (disposed.where((c("disposition") == MODELLABLE) & c("component").isNotNull())
            .groupBy("session_key", "session_id", "population", "component")
            .agg(S.joined_set(c("component_raw"), "|").alias("raw_variants"), F.count("*").alias("weighing_events"),
                 S.joined_set(c("scale_id")).alias("scale_ids"), S.strict_sum(c("weight_g")).alias("component_weight_g"),
                 F.min("source_snapshot_id").alias("source_snapshot_id")))


def fact_context(observations: DataFrame, cfg: Config) -> DataFrame:
    """Long observations to one row per (station, hour): a value and a status per parameter; a missing row is MISSING, not zero.

    A duplicate (hour, parameter), an unrequested parameter or a time that is no UTC instant stops the job.
    """
    c = F.col
    aggregates: list[Column] = []
    for p in cfg.context_parameters:
        mine = c("parameter") == p
        aggregates += [F.max(F.when(mine, c("value"))).alias(f"{p}_value"),
                       F.coalesce(F.max(F.when(mine, c("value_status"))), F.lit("MISSING")).alias(f"{p}_status"),
                       F.count_if(mine).alias(f"{p}_rows")]
    wide = observations.groupBy("station", "obs_utc").agg(
        *aggregates, F.count_if(~c("parameter").isin(*cfg.context_parameters)).alias("unknown_rows"),
        S.joined_set(c("source_file")).alias("source_files"), F.count("*").alias("observations"))
    bad = (c("unknown_rows") > 0) | c("obs_utc").isNull()
    for p in cfg.context_parameters:
        bad = bad | (c(f"{p}_rows") > 1)
    any_null = F.lit(False)
    for p in cfg.context_parameters:
        any_null = any_null | (c(f"{p}_status") != "OK")
    guarded = F.when(bad, F.raise_error(F.lit("context grain is not one row per station, hour and requested parameter"))).otherwise(c("obs_utc"))
    return wide.select("station", guarded.alias("obs_utc"),
                       *[c(f"{p}_{kind}") for p in cfg.context_parameters for kind in ("value", "status")],
                       any_null.alias("is_null_any"), "source_files", "observations")


def join_context(sessions: DataFrame, context: DataFrame | None, cfg: Config, null_checks: tuple[str, ...] = ()) -> DataFrame:
    """Context of the hour that ends at or after the first weighing, with the outcome of the join.

    An equality join on the ceiled hour. `context` has a row per station hour; Spark broadcasts it while it is small by its own
    size check and sorts and merges beyond. A session without context stays a valid session.
    """
    c = F.col
    hour = F.when(~c("is_quarantined"), T.ceil_hour(c("first_weighing_utc")))
    houred = sessions.withColumn("context_hour_utc", hour)
    checks = null_checks or cfg.context_parameters[:2]
    if context is None:
        return houred.withColumns({
            "context_join_status": F.when(c("is_quarantined"), "NOT_ATTEMPTED_QUARANTINED").when(hour.isNull(), "NO_TIMESTAMP")
            .otherwise("WEATHER_BLOCKED"),
            "context_matched": F.lit(False), **{f"{p}_null": F.lit(None).cast("boolean") for p in checks}})
    side = context.select(c("obs_utc").alias("context_hour_utc"), F.lit(True).alias("found"),
                          *[(c(f"{p}_status") != "OK").alias(f"{p}_null") for p in checks])
    joined = houred.join(side, "context_hour_utc", "left")
    return joined.withColumns({
        "context_join_status": F.when(c("is_quarantined"), "NOT_ATTEMPTED_QUARANTINED").when(c("context_hour_utc").isNull(), "NO_TIMESTAMP")
        .when(c("found"), "MATCHED").otherwise("UNMATCHED_NO_OBSERVATION"),
        "context_matched": F.coalesce(c("found"), F.lit(False)),
    }).drop("found")


def _file_list(lists: Column) -> Column:
    """Distinct files out of a set of `;` lists; bounded by the files one day's sessions come from."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(F.array_join(lists, ";"), ";"))), ";")


def daily_volume(facts: DataFrame, cfg: Config) -> DataFrame:
    """Valid sessions per service day and population, with flags that never exclude a day. Days without a valid session drop out."""
    c = F.col
    valid = ~c("is_quarantined") & (c("modellable_event_count") > 0)
    days = (facts.where(c("service_date").isNotNull())
            .groupBy("service_date", "population")
            .agg(F.count_if(valid).alias("sessions"), F.count_if("is_quarantined").alias("quarantined_sessions"),
                 F.sum(F.when(valid, c("modellable_event_count")).otherwise(0)).alias("events"),
                 F.min("source_snapshot_id").alias("source_snapshot_id"),
                 _file_list(F.collect_set(F.when(valid, c("source_files")))).alias("source_files"))
            .where("sessions > 0"))
    return with_regime(days, c("service_date"), cfg)


def with_regime(days: DataFrame, day: Column, cfg: Config) -> DataFrame:
    """Observed and expected regime of a day. Only days of the primary population are flagged."""
    c = F.col
    primary = c("population") == cfg.primary
    expected = F.lit(None).cast("string")
    for weekday, regime in cfg.weekday_regime.items():
        expected = F.when(c("weekday") == weekday, F.lit(regime)).otherwise(expected)
    low = c("sessions") < cfg.day_minimum
    return (days.withColumn("weekday", T.weekday_name(day))
            .withColumn("observed_regime", F.when(low, "low").otherwise("high"))
            .withColumn("expected_regime", F.when(primary, expected))
            .withColumn("low_volume_day", primary & low)
            .withColumn("volume_irregularity", F.coalesce(c("observed_regime") != c("expected_regime"), F.lit(False))))
