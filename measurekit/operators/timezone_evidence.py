"""What each candidate offset would do to the corrected files: service hours, time of day and the context join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from measurekit.config import Config
from measurekit.functions import stats as S
from measurekit.functions import times as T

OFFSETS = (0, 1, 2, 3, 4)


def _files(cfg: Config) -> list[str]:
    return [o.source_file for o in cfg.overrides]


def core_walls(disposed: DataFrame, ws: DataFrame, cfg: Config) -> DataFrame:
    """Raw wall times of the non-repeat events of core-ready sessions in corrected files."""
    c = F.col
    core = ws.where(c("core_ready") & (c("population") == cfg.primary)).select("session_key")
    rows = disposed.where((c("disposition") != "DUPLICATE_EXCLUDED") & c("source_file").isin(_files(cfg)) & c("event_local").isNotNull())
    return rows.join(core, "session_key", "left_semi").select(
        "session_key", "source_file", T.raw_wall(c("event_local"), c("tz_offset_hours")).alias("wall"))


def shifted_first_hours(walls: DataFrame) -> DataFrame:
    """Per offset: median over days of the day's first event hour, after shifting the raw times."""
    c = F.col
    shifted = walls.select(F.explode(F.array(*[F.lit(h) for h in OFFSETS])).alias("offset_hours"), "wall").withColumn(
        "t", c("wall") + T.hours(c("offset_hours")))
    days = shifted.groupBy("offset_hours", c("t").cast("date").alias("day")).agg(T.hour_fraction(F.min("t")).alias("h"))
    return days.groupBy("offset_hours").agg(S.exact_median(c("h")).alias("median_first_hour"))


def other_files_median(disposed: DataFrame, cfg: Config) -> DataFrame:
    """Median over the other files of the population of their median first-event hour (sessions not quarantined)."""
    c = F.col
    rows = disposed.where((c("disposition") == "MODELLABLE") & (c("population") == cfg.primary) & ~c("source_file").isin(_files(cfg))
                          & c("event_local").isNotNull())
    wall = T.raw_wall(c("event_local"), c("tz_offset_hours"))
    days = rows.groupBy("source_file", wall.cast("date").alias("day")).agg(T.hour_fraction(F.min(wall)).alias("h"))
    files = days.groupBy("source_file").agg(S.exact_median(c("h")).alias("h"))
    return files.agg(S.exact_median(c("h")).alias("others_median_hour"))


def shared_offset(cfg: Config) -> int:
    """The offset all corrected files share: what the evidence shifts against. Several offsets or none stop the job."""
    offsets = {o.offset_hours for o in cfg.overrides}
    if len(offsets) != 1:
        raise ValueError(f"the time-zone evidence needs corrections of one offset, found {sorted(offsets)}")
    return offsets.pop()


def session_effects(ws: DataFrame, context: DataFrame, cfg: Config, temperature: str, rain: str) -> DataFrame:
    """Per offset: sessions of corrected files, those leaving service hours, those whose context hour changes, the mean change of
    one context value, and the share of hours in which another is positive."""
    c = F.col
    base_offset = shared_offset(cfg)
    mine = ws.where(c("core_ready") & (c("population") == cfg.primary) & c("override_first_wall").isNotNull())
    structs = [F.struct(F.lit(h).alias("offset_hours"), c(f"tz_out_{h}").alias("violates"),
                        (c("override_first_wall") + T.hours(h)).alias("local")) for h in OFFSETS]

    def hour_of(local):
        return T.ceil_hour(T.utc_candidate(local, cfg.zone))

    rows = mine.select("session_key", "override_first_wall", F.inline(F.array(*structs))).select(
        "session_key", "offset_hours", "violates", hour_of(c("local")).alias("hour"),
        hour_of(c("override_first_wall") + T.hours(base_offset)).alias("base_hour"))
    side = context.select(c("obs_utc"), c(f"{temperature}_value").alias("temperature"), c(f"{rain}_value").alias("rain"))
    joined = (rows.join(side.withColumnRenamed("obs_utc", "hour"), "hour", "left")
              .join(side.select(c("obs_utc").alias("base_hour"), c("temperature").alias("base_temperature")), "base_hour", "left"))
    return joined.groupBy("offset_hours").agg(
        F.count("*").alias("sessions"), F.count_if("violates").alias("violators"),
        F.count_if(c("hour") != c("base_hour")).alias("changed_hours"),
        F.avg(F.abs(c("temperature") - c("base_temperature"))).alias("mean_abs_change"),
        S.percent(F.count_if(c("rain") > 0), F.count("rain")).alias("rainy_share_pct"))


def timezone_evidence(disposed: DataFrame, ws: DataFrame, context: DataFrame, cfg: Config, temperature: str, rain: str) -> DataFrame:
    c = F.col
    low, high = cfg.first_hour_band
    medians = shifted_first_hours(core_walls(disposed, ws, cfg))
    others = other_files_median(disposed, cfg).withColumn("one", F.lit(1))
    joined = (session_effects(ws, context, cfg, temperature, rain).join(medians, "offset_hours").withColumn("one", F.lit(1))
              .join(F.broadcast(others), "one", "left"))      # one row
    m, o = c("median_first_hour"), c("others_median_hour")
    return joined.select(
        "offset_hours", (c("offset_hours") == shared_offset(cfg)).alias("is_baseline"), "sessions", "violators",
        F.round(m, 2).alias("median_first_hour"), F.round(o, 2).alias("others_median_hour"), F.round(F.abs(m - o), 2).alias("gap_h"),
        S.inside_half_open(m, low, high).alias("inside_band"), "changed_hours",
        F.round("mean_abs_change", 3).alias("mean_abs_change"), F.round("rainy_share_pct", 2).alias("rainy_share_pct"))
