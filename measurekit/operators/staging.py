"""Verbatim rows to typed rows. No row is dropped; the verbatim text stays beside every typed value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from measurekit.config import Config
from measurekit.functions import text as X
from measurekit.functions import times as T

REQUIRED = ("session_id", "weighing_event_time", "scale_identifier", "weight_of_a_component", "component_name", "tray_id",
            "user_identification_time")
OPTIONAL = ("weighting_type",)
# cells of a row in declared order, the basis of the row hash where the reader gives no cells
CELLS = ("session_id", "weighing_event_time", "weighting_type", "scale_identifier", "weight_of_a_component", "component_name",
         "tray_id", "user_identification_time")


def with_population(df: DataFrame, cfg: Config) -> DataFrame:
    return df.withColumn("population", X.population_of(F.col("source_file"), cfg.populations))


def with_keys(df: DataFrame) -> DataFrame:
    """event id `file#row`; the session key carries the population, so equal ids in two populations stay two sessions."""
    return (df.withColumn("event_id", F.concat_ws("#", "source_file", F.col("source_row_number").cast("string")))
            .withColumn("session_key", F.concat_ws("|", "session_id", "population")))


def time_treatment(df: DataFrame, cfg: Config) -> DataFrame:
    """Clock correction per file, with its label and reason; every other file is taken as local time."""
    f = F.col("source_file")
    return (df.withColumn("tz_offset_hours", T.override_offset(f, cfg.overrides))
            .withColumn("tz_handling", T.override_label(f, cfg.overrides))
            .withColumn("tz_reason", T.override_reason(f, cfg.overrides)))


def stage_events(raw: DataFrame, cfg: Config) -> DataFrame:
    """One typed row per source row.

    `raw` holds the columns of REQUIRED and OPTIONAL as text, `source_file` and `source_row_number`; the delimited reader also
    gives `row_status`, `unmapped` and `row_sha256`, which default here for other sources.
    """
    have = set(raw.columns)
    cell = {c: F.coalesce(F.col(c), F.lit("")) for c in REQUIRED}
    hashed = F.col("row_sha256") if "row_sha256" in have else X.row_hash([F.col(c) for c in CELLS if c in have])
    base = raw.select(
        "source_file",
        "source_row_number",
        hashed.alias("row_sha256"),
        (F.col("source_snapshot_id") if "source_snapshot_id" in have else F.lit("snapshot")).alias("source_snapshot_id"),
        (F.col("row_status") if "row_status" in have else F.lit("OK")).alias("row_status"),
        (F.col("unmapped") if "unmapped" in have else F.lit(None).cast("string")).alias("unmapped"),
        cell["session_id"].alias("session_id"),
        cell["tray_id"].alias("tray_id"),
        cell["scale_identifier"].alias("scale_id"),
        cell["component_name"].alias("component_raw"),
        cell["weight_of_a_component"].alias("weight_raw"),
        (F.nullif(F.col("weighting_type"), F.lit("")) if "weighting_type" in have else F.lit(None).cast("string")).alias("weighing_type"),
        cell["weighing_event_time"].alias("event_time_raw"),
        cell["user_identification_time"].alias("ident_time_raw"),
    )
    # each step is a projection of its own: a value that several later columns use is worked out once
    parts = X.scale_parts(F.col("scale_id"), [word for word, _ in cfg.scale_kinds])
    keyed = time_treatment(with_keys(with_population(base, cfg)), cfg)
    shift = T.hours(F.col("tz_offset_hours"))
    parsed = keyed.withColumns({
        **{f"scale_{name}": c for name, c in parts.items()},
        "component": X.norm_name(F.col("component_raw")),
        "has_edge_space": X.has_edge_space(F.col("component_raw")),
        "weight_status": X.weight_status(F.col("weight_raw")),
        "event_local": T.parse_time(F.col("event_time_raw")) + shift,
        "ident_local": T.parse_time(F.col("ident_time_raw")) + shift,
    })
    timed = parsed.withColumns({
        "weight_g": F.when(F.col("weight_status") == "OK", X.strip(F.col("weight_raw")).try_cast("bigint")),
        "event_time_format": T.time_format(F.col("event_time_raw"), F.col("event_local")),
        "ident_time_format": T.time_format(F.col("ident_time_raw"), F.col("ident_local")),
        "event_candidate": T.utc_candidate(F.col("event_local"), cfg.zone),
        "ident_candidate": T.utc_candidate(F.col("ident_local"), cfg.zone),
    })
    located = timed.withColumns({
        f"{n}_time_status": T.status_of(F.col(f"{n}_local"), F.col(f"{n}_candidate"), cfg.zone) for n in ("event", "ident")})
    return located.withColumns({
        f"{n}_utc": F.when(F.col(f"{n}_time_status") == "OK", F.col(f"{n}_candidate")) for n in ("event", "ident")
    }).drop("event_candidate", "ident_candidate")


def stage_observations(raw: DataFrame) -> DataFrame:
    """Long context rows, typed. NaN becomes NULL and never zero; what is no number becomes NULL and says so."""
    v = X.strip(F.coalesce(F.col("value_raw"), F.lit("")))
    number = v.rlike("^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$")
    status = F.when(F.lower(v) == "nan", "NAN_SOURCE_NULL").when(number, "OK").otherwise("UNPARSEABLE")
    return (raw.withColumn("obs_utc", T.parse_utc(F.col("time_raw")))
            .withColumn("value_status", status)
            .withColumn("value", F.when(F.col("value_status") == "OK", v.try_cast("double"))))


def in_source_order(staged: DataFrame) -> DataFrame:
    return staged.orderBy("source_file", "source_row_number")
