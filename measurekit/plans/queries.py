"""The registered queries: every operator over the supplied tables. Times come out as text and doubles rounded to 6 places."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from measurekit.functions import stats as S
from measurekit.functions import text as X
from measurekit.functions import times as T
from measurekit.operators import checks as K
from measurekit.operators import findings as FI
from measurekit.operators import metrics as M
from measurekit.operators import profiles as P
from measurekit.operators import profiling as PR
from measurekit.operators import quantiles as Q
from measurekit.operators import repeats as R
from measurekit.operators import rules_context as RC
from measurekit.operators import rules_events as RE
from measurekit.operators import rules_files as RF
from measurekit.operators import rules_sessions as RS
from measurekit.operators import rules_volume as RV
from measurekit.operators import scenarios as SC
from measurekit.operators import timezone_evidence as TZ
from measurekit.operators.ranges import lagged, range_blocks
from measurekit.operators.staging import with_keys, with_population
from measurekit.plans import drift, roles
from measurekit.plans.measurement import Measurement, TableStore
from measurekit.sources import calendar as CAL
from measurekit.sources import delimited as DE
from measurekit.sources import inventory as INV
from measurekit.sources import observations as OB

CFG = roles.CONFIG
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
c = F.col

REGISTRY = SC.default_registry(CFG, (dt.date(2024, 1, 22), dt.date(2024, 1, 26)), dt.date(2024, 1, 15))
BASELINE_CUTOFF = dt.date(2024, 1, 22)
NATURAL_KEY = ["session_id", "event_time_raw", "scale_id", "weight_raw", "component_raw"]


_OPEN: dict[tuple[str, str], Measurement] = {}


def measurement(spark: SparkSession, sf_dir: str) -> Measurement:
    """The measurement of a folder of tables, one per application, with its shared steps kept as written tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = Measurement(roles.raw_events(spark, sf_dir), roles.raw_observations(spark, sf_dir), CFG, TableStore.for_source(spark, sf_dir, CFG))
    return _OPEN[key]


def query(name: str):
    """Register a query of a measurement under a name."""
    def add(fn: Callable[[Measurement], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(measurement(spark, sf_dir))
        return fn
    return add


def table_query(name: str):
    """Register a query of the supplied tables."""
    def add(fn: Query):
        QUERIES[name] = fn
        return fn
    return add


def txt(name: str, alias: str | None = None) -> Column:
    return T.iso_text(c(name)).alias(alias or name)


def r6(value: Column | str, alias: str) -> Column:
    return F.round(value, 6).alias(alias)


# ---- sources ------------------------------------------------------------------------------------------------------------------------
def drifting_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows the reader makes of lines written from `events`."""
    return DE.rows_of(DE.joined_records(drift.event_lines(spark, sf_dir), drift.MOST_LINES), drift.REQUIRED, drift.OPTIONAL)


@table_query("src01_cells")
def _(spark, sf_dir):
    return drifting_rows(spark, sf_dir).select("source_file", "source_row_number", "event_id", "ts", "amount", "note", "row_status", "row_sha256")


@table_query("src02_unmapped")
def _(spark, sf_dir):
    return drifting_rows(spark, sf_dir).where("unmapped IS NOT NULL").select("source_file", "source_row_number", "unmapped")


@table_query("src07_header_classes")
def _(spark, sf_dir):
    records = DE.joined_records(drift.event_lines(spark, sf_dir), drift.MOST_LINES)
    variants = {"V4": drift.HEADERS["click"].split(","), "V3": drift.HEADERS["signup"].split(",")}
    return DE.classify_headers(DE.headers_of(records), variants, [*drift.REQUIRED, "note"]).select(
        "source_file", "fingerprint", "variant", F.array_join("missing", ";").alias("missing"), F.array_join("unexpected", ";").alias("unexpected"), "blank_columns", "header_status")


@query("src04_observation_typing")
def _(m):
    return m.observations.select("observation_id", txt("obs_utc"), "parameter", "value_raw", "value_status", "value")


@table_query("src03_xml_elements")
def _(spark, sf_dir):
    return OB.parse_elements(drift.event_elements(spark, sf_dir)).select("event_id", "time_raw", "parameter", "value_raw", "reject_reason")


def file_list(m: Measurement) -> DataFrame:
    """The mapped files as an inventory: name, rows as size, and a hash of what identifies them."""
    per = m.raw.groupBy("source_file").agg(F.count("*").alias("size"))
    return per.select(F.lit("events").alias("kind"), "source_file", F.sha2(F.concat_ws("/", "source_file", c("size").cast("string")), 256).alias("sha256"), "size")


@query("src08_snapshot_id")
def _(m):
    return INV.snapshot_id(file_list(m))


@query("src09_content_hash")
def _(m):
    return INV.content_fingerprint(m.observations, ["time_raw", "parameter", "value_raw"])


@table_query("src09_document_fingerprint")
def _(spark, sf_dir):
    return INV.content_fingerprint(roles.table(spark, sf_dir, "documents"), ["doc_id", "lang", "source", "text", "n_chars"])


@query("src13_calendar")
def _(m):
    days = RV.service_days(m.session_flags, CFG)
    spine = RV.expected_days(days, CFG)
    seen = days.select("population", c("service_date").alias("day"), "sessions")
    return spine.join(seen, ["population", "day"], "left").select(
        "population", c("day").cast("string").alias("day"), T.week_start(c("day")).cast("string").alias("week"), F.coalesce("sessions", F.lit(0)).alias("sessions"))


@query("src13_hour_calendar")
def _(m):
    spine = CAL.hour_spine(m.spark, *CFG.context_window)
    seen = m.observations.groupBy(c("obs_utc").alias("hour")).agg(F.count("*").alias("n"))
    return spine.join(seen, "hour", "left").groupBy(F.hour("hour").alias("hour_of_day")).agg(F.count("*").alias("hours"), F.count("n").alias("observed"))


@query("src14_completeness")
def _(m):
    declared = m.raw_observations.groupBy("source_file").agg(F.count("*").alias("declared_rows"))
    return RC.completeness(m.observations, declared, CFG)


# ---- scalars ------------------------------------------------------------------------------------------------------------------------
@query("prj01_norm_name")
def _(m):
    return m.staged.groupBy("component_raw", "component").agg(F.count("*").alias("n"))


@query("prj02_edge_space")
def _(m):
    return m.staged.groupBy("source_file").agg(F.count_if("has_edge_space").alias("edge_rows"), F.count("*").alias("n"))


@query("prj03_parse_weight")
def _(m):
    return m.staged.select("event_id", "weight_raw", "weight_status", "weight_g")


@query("prj04_scale_parts")
def _(m):
    return m.staged.groupBy("scale_id", "scale_line", "scale_side", "scale_kind", c("scale_position").cast("bigint").alias("scale_position")).agg(F.count("*").alias("n"))


@query("prj05_station_family")
def _(m):
    return m.staged.groupBy(X.station_family(c("scale_id")).alias("station_family"), X.scale_kind_label(c("scale_id"), CFG.scale_kinds).alias("kind")).agg(F.count("*").alias("n"))


@query("prj06_parse_time")
def _(m):
    return m.staged.select("event_id", "event_time_raw", "event_time_format", T.iso_text(T.raw_wall(c("event_local"), c("tz_offset_hours"))).alias("wall"),
                           "ident_time_format", "ident_time_status")


@query("prj07_tz_treatment")
def _(m):
    return m.staged.groupBy("source_file", "tz_handling", c("tz_offset_hours").cast("bigint").alias("tz_offset_hours")).agg(
        F.count("*").alias("n"), T.iso_text(F.min("event_local")).alias("first_local"))


@table_query("prj08_local_to_utc")
def _(spark, sf_dir):
    # ship dates as wall times through the day: dates around both clock changes are in the table
    li = roles.table(spark, sf_dir, "lineitem")
    local = c("l_shipdate") + F.make_dt_interval(mins=((c("l_orderkey") * 7 + c("l_linenumber") * 13) % 360).cast("int"))
    return (li.select("l_orderkey", "l_linenumber", local.alias("wall"))
            .groupBy("wall").agg(F.count("*").alias("n"))        # equal wall times are converted once
            .withColumn("candidate", T.utc_candidate(c("wall"), CFG.zone))
            .withColumn("status", T.status_of(c("wall"), c("candidate"), CFG.zone))
            .select(txt("wall"), "status", F.when(c("status") == "OK", T.iso_text(c("candidate"))).alias("utc"), "n"))


@query("prj09_row_hash")
def _(m):
    return m.staged.select("event_id", "row_sha256")


@query("prj10_keys")
def _(m):
    return with_keys(with_population(m.raw, CFG)).select("event_id", "session_key")


@query("prj11_population")
def _(m):
    return with_population(m.raw, CFG).groupBy("source_file", "population").agg(F.count("*").alias("n"))


@query("prj12_raw_wall")
def _(m):
    return m.staged.where(c("event_local").isNotNull()).select("event_id", txt("event_local"), T.iso_text(T.raw_wall(c("event_local"), c("tz_offset_hours"))).alias("wall"))


@query("prj13_hour_fraction")
def _(m):
    return m.staged.where(c("event_local").isNotNull()).select("event_id", r6(T.hour_fraction(c("event_local")), "hour_fraction"))


@query("prj14_ceil_hour")
def _(m):
    return m.staged.where(c("event_utc").isNotNull()).select("event_id", T.iso_text(T.ceil_hour(c("event_utc"))).alias("hour"))


@table_query("prj15_weekday")
def _(spark, sf_dir):
    d = c("o_orderdate").cast("date")
    return roles.table(spark, sf_dir, "orders").groupBy(d.cast("string").alias("day"), T.weekday_name(d).alias("weekday"), T.week_start(d).cast("string").alias("week"),
                                                        T.is_weekend(d).alias("weekend")).agg(F.count("*").alias("n"))


@query("prj16_finding_id")
def _(m):
    return m.staged.select("event_id", X.finding_id(F.lit("S06"), F.lit("event"), c("event_id")).alias("finding_id"))


@query("prj17_quality_status")
def _(m):
    return m.fact_event.select("event_id", "quality_status")


@query("prj18_session_timing")
def _(m):
    return m.session_flags.select("session_key", "span_s", r6(c("span_s") / 60, "duration_minutes"), "ident_minus_last_s")


@query("prj19_masks")
def _(m):
    return m.staged.groupBy(X.digit_mask(c("event_time_raw")).alias("time_shape"), X.collapse_twin(c("scale_id"), CFG.twin_sides).alias("twin"), X.id_number(c("tray_id")).alias("tray_number")).agg(F.count("*").alias("n"))


def deltas(m: Measurement) -> DataFrame:
    return SC.metric_deltas(scenario_results(m), REGISTRY)


@query("prj20_deltas")
def _(m):
    return deltas(m).select("metric_id", "scenario_id", r6("absolute_delta", "absolute_delta"), r6("relative_delta", "relative_delta"))


@query("prj21_classify")
def _(m):
    return deltas(m).select("metric_id", "scenario_id", "robustness_class")


# ---- filters ------------------------------------------------------------------------------------------------------------------------
@query("flt1_populations")
def _(m):
    pops = M.populations(CFG)
    one = m.facts.agg(*[F.count_if(cond).alias(name) for name, cond in pops.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("population"), c(n).alias("sessions")) for n in pops])))


@query("flt2_threshold")
def _(m):
    return m.staged.where(S.compare(c("weight_g"), CFG.large_weight)).select("event_id", "weight_g")


@query("flt3_bands")
def _(m):
    lo, hi = CFG.session_weight
    sessions = m.session_flags.where(S.outside_closed(c("weight_counted"), lo, hi)).agg(F.count("*").alias("outside_weight"))
    hours = m.staged.agg(F.count_if(S.inside_half_open(F.hour("event_local"), *CFG.service_hours)).alias("inside_hours"))
    return K.beside(sessions, hours)


@query("flt4_date_selector")
def _(m):
    live = SC.with_bounds(working(m), m.flagged, m.volume, CFG).where("core_ready")
    ops = {s.scenario_id: s.operation for s in REGISTRY if s.operation["kind"] == "exclude_dates"}
    one = live.agg(*[F.count_if(SC.date_selector(op)).alias(i) for i, op in ops.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(i).alias("scenario_id"), c(i).alias("sessions")) for i in ops])))


@query("flt5_windows")
def _(m):
    day = c("event_local").cast("date")
    return m.staged.agg(F.count_if(~day.between(*[F.lit(d) for d in CFG.window])).alias("outside_window"), F.count_if(T.is_weekend(day)).alias("weekend"),
                        F.count_if(day.isNull()).alias("without_time"))


@query("flt6_non_null")
def _(m):
    return M.non_null(M.select_population(m.facts, M.C_ELIGIBLE, CFG), "selected_weight_g")


# ---- joins --------------------------------------------------------------------------------------------------------------------------
@query("join01_event_status")
def _(m):
    return m.fact_event.select("event_id", "disposition", F.coalesce("quarantine_rule_ids", F.lit("")).alias("quarantine_rule_ids"))


@query("join02_session_context")
def _(m):
    return m.facts_with_context.select("session_key", txt("context_hour_utc"), "context_join_status", "context_matched")


@query("join03_session_context_inner")
def _(m):
    core = M.select_population(m.facts_with_context, M.D_CORE, CFG).select(c("context_hour_utc").alias("obs_utc"))
    return core.join(m.context.select("obs_utc"), "obs_utc").agg(F.count("*").alias("matches"))


@query("join04_missing_hours")
def _(m):
    return RC.coverage_gaps(m.observations, CFG).groupBy("kind").agg(F.sum("hours").alias("hours"), F.count("*").alias("ranges"))


@query("join05_crossover")
def _(m):
    return P.crossover_ids(m.profiles)


@query("join06_versions")
def _(m):
    return m.versions


@query("join07_repeat_of")
def _(m):
    return m.flagged.where("is_repeat").select("event_id", "repeats_event_id")


@query("join08_tray_overlap")
def _(m):
    return RS.tray_overlaps(m.session_flags)


@query("join09_neighbour_days")
def _(m):
    return RS.neighbour_day_names(m.staged, m.agreement, CFG).select(c("offset_days").cast("bigint").alias("offset_days"), "scale_days")


@query("join10_two_computations")
def _(m):
    ctl = K.session_controls(m.facts, K.rebuilt_sessions(m.controls))
    return ctl.select("session_key", "weight_control", "span_control", "count_control", "first_control")


@query("join11_files_vs_pins")
def _(m):
    files = file_list(m)
    return INV.compare_with_pins(drift.pinned_files(files), files, files.select("source_file", c("size").alias("rows")))


@query("join12_inventory_changes")
def _(m):
    files = file_list(m)
    before = drift.pinned_files(files).select("source_file", c("pinned_sha256").alias("sha256"))
    return INV.inventory_changes(before, files)


@query("join13_findings_to_sessions")
def _(m):
    return FI.findings_by_session(core_final(m), m.session_flags)


@query("join14_scenario_grid")
def _(m):
    return SC.members(bounded(m), REGISTRY, CFG).groupBy("scenario_id").agg(F.count("*").alias("members"), F.count("weight").alias("weights"))


@query("join15_rank_percentile")
def _(m):
    core = M.select_population(m.facts, M.D_CORE, CFG)
    return Q.ranked_percentiles(core, "selected_weight_g", [0.1, 0.5, 0.9, 0.99]).select("q", r6("value", "value"))


@query("join16_floor_ceil")
def _(m):
    return PR.hour_join_comparison(m.facts, m.context, "purchase", CFG)


@query("join17_lineage")
def _(m):
    core = M.select_population(m.facts, M.D_CORE, CFG).select("session_key")
    return m.disposed.where("disposition = 'MODELLABLE'").join(core, "session_key", "left_semi").select("session_key", "event_id", "weight_g")


@query("join18_parsed_ids")
def _(m):
    final = FI.finalise(RE.event_findings(m.flagged, CFG), CFG)
    return FI.rows_of_event_findings(final, m.staged).groupBy("rule_id", "session_key").agg(F.count("*").alias("n"))


@query("join19_regime")
def _(m):
    return RV.service_days(m.session_flags, CFG).select("population", c("service_date").cast("string").alias("day"), "observed_regime",
                                                        F.coalesce("expected_regime", F.lit("")).alias("expected_regime"))


@query("join20_single_events")
def _(m):
    return PR.single_event_sessions(m.flagged, m.session_flags, CFG)


@query("join20_single_event_summary")
def _(m):
    ones = PR.single_event_summary(PR.single_event_sessions(m.flagged, m.session_flags, CFG), CFG)
    return ones


# ---- aggregates ---------------------------------------------------------------------------------------------------------------------
@query("agg01_strict_sum")
def _(m):
    return m.profiles.select("session_key", "weight_counted", "weight_all")


@query("agg02_first_last_row")
def _(m):
    rows = m.flagged.where(~c("is_repeat") & c("event_utc").isNotNull())
    first = [c("event_utc"), c("source_file"), c("source_row_number")]
    last = [c("event_utc"), c("source_file"), -c("source_row_number")]
    return rows.groupBy("session_key").agg(S.first_row(first, c("event_id")).alias("first_event"), S.last_row(last, c("event_id")).alias("last_event"))


@query("agg03_single_value")
def _(m):
    return m.profiles.select("session_key", c("tray_single").alias("tray_id"), txt("ident_single_local", "ident_local"))


@query("agg04_median")
def _(m):
    return m.staged.groupBy("scale_id").agg(S.exact_median(c("weight_g")).alias("median_weight"))


@query("agg05_percentile")
def _(m):
    return m.staged.groupBy("scale_kind").agg(*[r6(S.exact_percentile(c("weight_g"), q), f"p{int(q * 100)}") for q in (0.1, 0.5, 0.9, 0.99)])


@query("agg06_count_by")
def _(m):
    return PR.count_by(m.fact_event, "weight_status", "event_time_status", "ident_time_status", "disposition")


@query("agg07_distinct_counts")
def _(m):
    return m.profiles.select("session_key", "n_components", "n_raw_components", "n_scales", "tray_count", "ident_values")


@query("agg08_joined_set")
def _(m):
    return m.staged.groupBy("scale_id").agg(S.joined_set(c("component"), "|").alias("components"), S.joined_set(c("source_file")).alias("files"))


@query("agg09_file_reconciliation")
def _(m):
    return K.file_reconciliation(m.staged)


@query("agg10_field_completeness")
def _(m):
    return PR.field_completeness(m.staged)


@query("agg11_findings_by_rule")
def _(m):
    return FI.by_rule(all_final(m))


@query("agg12_median_first_hour")
def _(m):
    return RF.median_first_hour(m.staged).select("source_file", r6("raw_hour", "raw_hour"), r6("treated_hour", "treated_hour"))


@query("agg13_other_files_median")
def _(m):
    return TZ.other_files_median(m.disposed, CFG).select(r6("others_median_hour", "others_median_hour"))


@query("agg14_pivot_observations")
def _(m):
    return m.context.select("station", txt("obs_utc"), *[c(f"{p}_{k}") for p in CFG.context_parameters for k in ("value", "status")], "is_null_any", "observations")


@query("agg15_daily_volume")
def _(m):
    return day_text(m.volume)


def day_text(df: DataFrame) -> DataFrame:
    return df.select(c("service_date").cast("string").alias("service_date"), "population", "weekday", "sessions", "quarantined_sessions", "events", "observed_regime",
                     F.coalesce("expected_regime", F.lit("")).alias("expected_regime"), "low_volume_day", "volume_irregularity", "source_files")


@query("agg16_baseline_regimes")
def _(m):
    return RV.baseline_regimes(RV.service_days(m.session_flags, CFG), CFG)


@query("agg17_fixed_ratio")
def _(m):
    pops = M.populations(CFG)
    den = F.count_if(pops[M.C_ELIGIBLE])
    return m.facts.agg(F.count_if(pops[M.D_CORE]).alias("numerator"), den.alias("denominator"), r6(S.percent(F.count_if(pops[M.D_CORE]), den), "pct"))


@query("agg18_distribution")
def _(m):
    return M.component_distribution(m.facts, CFG)


@query("agg19_portioning")
def _(m):
    return M.portioning_by_scale(m.disposed, m.facts, CFG)


@query("agg20_largest_event")
def _(m):
    return SC.largest_event(m.staged)


@query("agg21_ranges")
def _(m):
    return ranges_text(SC.scenario_ranges(deltas(m)))


def ranges_text(df: DataFrame) -> DataFrame:
    return df.select("metric_id", *[r6(n, n) for n in ("min_value", "max_value", "defensible_min", "defensible_max")], "scenarios", "defensible_scenarios",
                     "largest_absolute", "largest_relative")


@query("agg22_worst_class")
def _(m):
    rated = deltas(m).where(c("robustness_class") != SC.NOT_CLASSIFIED)
    return rated.groupBy("scenario_id").agg(SC.worst_class(c("robustness_class")).alias("worst_class"))


@query("agg23_offset_scan")
def _(m):
    return PR.offset_scan(m.staged, CFG).select(c("offset_h").cast("bigint").alias("offset_h"), r6("l1_distance", "l1_distance"))


@query("agg23_best_offset")
def _(m):
    return PR.best_offset(PR.offset_scan(m.staged, CFG)).select(c("best_offset").cast("bigint").alias("best_offset"))


@query("agg24_name_agreement")
def _(m):
    return m.agreement.select("scale_id", c("day").cast("string").alias("day"), "names", "shared", r6("jaccard", "jaccard"), "identical", "disjoint")


@query("agg24_agreement_by_period")
def _(m):
    return RS.agreement_summary(m.agreement, m.staged, CFG).select("in_corrected_file", "cells", r6("identical_share", "identical_share"), r6("jaccard", "jaccard"),
                                                                   r6("disjoint_share", "disjoint_share"))


@query("agg25_column_profile")
def _(m):
    return PR.column_profile(m.staged, CFG)


@query("agg25_weight_profile")
def _(m):
    return PR.weight_profile(m.staged).select("scope", "rows", "nonnumeric", "not_positive", "edge_space", txt("first_time"), txt("last_time"))


@query("agg26_population_profile")
def _(m):
    p = PR.population_profile(m.session_flags)
    doubles = [f.name for f in p.schema.fields if f.dataType.simpleString() == "double"]
    return p.select(*[r6(n, n) if n in doubles else c(n) for n in p.columns])


@query("agg27_drift_by_file")
def _(m):
    return PR.drift_by_file(m.flagged)


@query("agg27_time_shapes")
def _(m):
    return PR.time_shapes(m.flagged)


@query("agg28_robust_day_z")
def _(m):
    z = PR.robust_day_z(RV.service_days(m.session_flags, CFG), BASELINE_CUTOFF, CFG)
    return z.select(c("service_date").cast("string").alias("day"), "weekday", "sessions", r6("weekday_median", "weekday_median"), r6("ratio", "ratio"), r6("robust_z", "robust_z"))


@query("agg29_daily_composition")
def _(m):
    d = PR.daily_composition(m.session_flags, CFG)
    doubles = [f.name for f in d.schema.fields if f.dataType.simpleString() == "double"]
    return d.select(c("day").cast("string").alias("day"), *[r6(n, n) if n in doubles else c(n) for n in d.columns if n != "day"])


@query("agg30_share_table")
def _(m):
    rows = m.staged.select(X.station_family(c("scale_id")).alias("station_family"), F.coalesce(F.hour("event_local"), F.lit(-1)).cast("bigint").alias("hour_of_day"))
    return PR.share_table(rows, "station_family", "hour_of_day").select("station_family", "hour_of_day", "n", r6("share", "share"))


@query("agg31_spearman")
def _(m):
    rows = m.session_flags.where(c("first_utc").isNotNull()).select(X.id_number(c("session_id")).alias("id_number"), T.seconds_between(F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz"), c("first_utc")).alias("t"))
    return PR.spearman(rows, "id_number", "t").select(r6("spearman", "spearman"), "n")


@query("agg32_name_stability")
def _(m):
    return PR.name_stability(m.staged, CFG)


@query("agg32_name_variants")
def _(m):
    return PR.name_variants(m.staged)


@query("agg33_quantile_profile")
def _(m):
    p = PR.quantile_profile(m.staged, "weight_g", (0.5, 0.9, 0.95, 0.99, 0.995, 0.999), ["population"])
    return p.select("population", "n_values", r6("mean", "mean"), "min", "max", *[r6(n, n) for n in p.columns if n.startswith("p") and n != "population"])


@query("agg34_convention")
def _(m):
    # hourly totals against six 10-minute slots of the events themselves
    at = c("event_utc")
    slot = T.floor_hour(at) + T.hours(0) + F.make_dt_interval(mins=F.floor(F.minute(at) / 10).cast("int") * 10)
    slots = m.staged.where(at.isNotNull() & c("weight_g").isNotNull()).groupBy(slot.alias("t")).agg(F.sum("weight_g").alias("amount"))
    hourly = m.staged.where(at.isNotNull() & c("weight_g").isNotNull()).groupBy(T.ceil_hour(at).alias("hour")).agg(F.sum("weight_g").alias("total"))
    out = RC.convention_mae(hourly, slots)
    return out.select("hours", r6("mae_ending", "mae_ending"), r6("mae_starting", "mae_starting"))


@query("agg35_definition_contrast")
def _(m):
    return PR.definition_contrast(m.session_flags, CFG)


@query("agg36_pooled_multiplicity")
def _(m):
    return K.pooled_multiplicity(m.staged)


@query("agg37_natural_key_duplicates")
def _(m):
    return R.natural_key_duplicates(m.staged, NATURAL_KEY)


@table_query("agg37_lineitem_duplicates")
def _(spark, sf_dir):
    li = roles.table(spark, sf_dir, "lineitem").withColumn("population", c("l_linestatus"))
    return R.natural_key_duplicates(li, ["l_orderkey", "l_linenumber"])


@query("agg38_daily_by_population")
def _(m):
    return PR.daily_by_population(m.session_flags, CFG).select(c("service_date").cast("string").alias("service_date"), CFG.primary, CFG.other, "weekday")


@query("agg39_disjoint_share")
def _(m):
    return PR.disjoint_share_by_day(m.agreement).select(c("day").cast("string").alias("day"), r6("disjoint_share", "disjoint_share"), "cells")


@query("agg39_null_hours")
def _(m):
    return PR.context_null_hours(m.context, CFG.context_parameters)


@query("agg39_id_range")
def _(m):
    return PR.id_range_by_file(m.staged)


@query("agg39_rainy_sessions")
def _(m):
    core = M.select_population(m.facts_with_context, M.D_CORE, CFG)
    side = m.context.select(c("obs_utc").alias("context_hour_utc"), c("signup_value").alias("v"))
    return core.join(side, "context_hour_utc", "left").agg(F.count_if(c("v") > 500).alias("above"), F.count("v").alias("known"))


# ---- windows ------------------------------------------------------------------------------------------------------------------------
@query("win1_repeats")
def _(m):
    return R.mark_repeats(m.staged).groupBy("source_file").agg(F.count_if("is_repeat").alias("repeats"), F.count("*").alias("n"))


@table_query("win1_document_repeats")
def _(spark, sf_dir):
    docs = roles.table(spark, sf_dir, "documents").select(c("source").alias("source_file"), F.sha2("text", 256).alias("row_sha256"), c("doc_id").alias("source_row_number"))
    return R.mark_repeats(docs).where("is_repeat").select("source_file", "source_row_number", "repeats_event_id")


@query("win2_gaps")
def _(m):
    return PR.with_gaps(m.flagged).select("event_id", "gap_s", "scale_gap_s", "previous_weight", F.coalesce(c("same_name_as_previous").cast("string"), F.lit("")).alias("same_name"))


@table_query("win2_turn_gaps")
def _(spark, sf_dir):
    conv = roles.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    turns = lagged(range_blocks(conv, ["conv_id"], "turn"), ["conv_id"], ["turn"], {"previous_role": "role", "previous_turn": "turn"})
    return (turns.groupBy("role", F.coalesce("previous_role", F.lit("")).alias("previous_role")).agg(F.count("*").alias("n"), F.sum(c("turn") - c("previous_turn")).alias("turn_gap")))


@query("win3_ranked_percentile")
def _(m):
    return Q.ranked_percentiles(m.staged.withColumn("w", c("weight_g").cast("double")), "w", [0.25, 0.5, 0.75, 0.95], ["population"]).select("population", "q", r6("value", "value"))


@query("win4_hour_ranges")
def _(m):
    return RC.coverage_gaps(m.observations, CFG).select("kind", txt("first_hour"), txt("last_hour"), "hours")


@query("win5_duplicated_members")
def _(m):
    live = m.flagged.where(~c("is_repeat"))
    return R.duplicated_members(live, ["session_key", "scale_id"]).select("event_id", "session_key", "scale_id")


@query("win6_repeat_share")
def _(m):
    return PR.repeat_share(m.flagged).select("session_key", "total", "repeat_weight", r6("repeat_pct", "repeat_pct"))


@query("win6_repeat_share_summary")
def _(m):
    return PR.repeat_share_summary(PR.repeat_share(m.flagged)).select(r6("median_pct", "median_pct"), r6("p90_pct", "p90_pct"))


@query("win7_percent_position")
def _(m):
    return PR.largest_event_context(m.flagged, m.facts, CFG)


@query("win8_inversions")
def _(m):
    return R.inversions(m.staged)


# ---- order --------------------------------------------------------------------------------------------------------------------------
@query("ord1_finding_order")
def _(m):
    return FI.in_catalogue_order(core_final(m)).select(c("rule_order").cast("bigint").alias("rule_order"), "population", "entity_id", "event_id")


@query("ord2_staging_order")
def _(m):
    return m.staged.orderBy("source_file", "source_row_number").select("source_file", "source_row_number", "event_id")


@query("ord3_top_scales")
def _(m):
    return PR.top_scales_by_flag_rate(M.portioning_by_scale(m.disposed, m.facts, CFG)).select("scale_id", "heavy_rate_pct")


@query("ord4_large_events")
def _(m):
    return PR.events_at_least(m.flagged, m.facts, 1500)


@query("ord5_longest_sessions")
def _(m):
    return PR.longest_sessions(m.session_flags, 20)


@query("ord5_disagreement_examples")
def _(m):
    return PR.disagreement_examples(m.agreement, 8).select("scale_id", c("day").cast("string").alias("day"), "names")


# ---- findings -----------------------------------------------------------------------------------------------------------------------
def event_part(m): return RE.event_findings(m.flagged, CFG)
def session_part(m): return RS.session_findings(m.sessions, CFG)
def version_part(m): return RS.version_findings(m.versions)
def name_part(m): return RS.name_findings(m.agreement)
def file_part(m): return RF.file_findings(RF.file_profile(m.staged), CFG).unionByName(RF.scope_findings(m.staged, CFG))
def context_part(m): return RC.context_findings(m.observations, CFG)


def day_part(m):
    days = RV.service_days(m.session_flags, CFG)
    return RV.volume_findings(days, CFG).unionByName(RV.coverage_findings(days, CFG))


def core_final(m: Measurement) -> DataFrame:
    """Findings on events, sessions, names and files: an output of validation that status, manifest and summaries start from."""
    return m.kept("findings_core", lambda: FI.finalise(FI.concat_findings([event_part(m), session_part(m), version_part(m), name_part(m), file_part(m)]), CFG))


def all_final(m: Measurement) -> DataFrame:
    rest = lambda: FI.finalise(day_part(m).unionByName(context_part(m)).unionByName(K.partition_findings(m.controls)), CFG)
    return core_final(m).unionByName(m.kept("findings_days_and_context", rest))


FINDING_FIELDS = ("finding_id", "rule_id", "severity", "handling", "entity_type", "entity_id", "session_key", "event_id", "population")


def rule_query(rule: str, part: Callable[[Measurement], DataFrame]) -> None:
    @query(f"rule_{rule}")
    def _(m):
        return FI.finalise(part(m).where(c("rule_id") == rule), CFG).select(*FINDING_FIELDS)


# The correction as if it had been checked on the first four days of its file only.
SHORT_EVIDENCE = replace(CFG, overrides=tuple(replace(o, last_date=dt.date(2024, 1, 11)) for o in CFG.overrides))


@query("rule_T10")
def _(m):
    return FI.finalise(RF.file_findings(RF.file_profile(m.staged), SHORT_EVIDENCE).where(c("rule_id") == "T10"), SHORT_EVIDENCE).select(*FINDING_FIELDS)


@query("rule_X04")
def _(m):
    # as if a source had supplied the UTC times and some were an hour off
    wrong = F.when(c("source_row_number") % 617 == 0, c("event_utc") + T.hours(1)).otherwise(c("event_utc"))
    rows = m.flagged.drop(*[n for n in m.flagged.columns if n.startswith("hit_")]).withColumn("event_utc", wrong)
    return FI.finalise(RE.event_findings(RE.flag_events(rows, CFG), CFG).where(c("rule_id") == "X04"), CFG).select(*FINDING_FIELDS)


for _rule in ("S05", "S06", "S07", "B01", "B02", "B03", "T01", "T02", "T03", "I02", "S04", "S08"):
    rule_query(_rule, event_part)
for _rule in ("I01", "I04", "T06", "B04", "B05", "B07", "T05", "T04"):
    rule_query(_rule, session_part)
rule_query("I06", version_part)
rule_query("I07", name_part)
for _rule in ("S03", "T07", "T08"):
    rule_query(_rule, file_part)
for _rule in ("C01", "C02a", "C02b", "C03"):
    rule_query(_rule, day_part)
for _rule in ("X01", "X03", "X07", "X08"):
    rule_query(_rule, context_part)


@query("rule_T09")
def _(m):
    return R.inversions(m.staged).where("inversions > 0")


@query("rule_I03")
def _(m):
    return R.duplicated_members(m.staged, NATURAL_KEY).select("event_id", *NATURAL_KEY)


@query("rule_I05")
def _(m):
    return RS.tray_overlaps(m.session_flags).where("overlapping_pairs > 0")


@query("rule_X02")
def _(m):
    return m.facts_with_context.where("context_join_status = 'UNMATCHED_NO_OBSERVATION'").select("session_key", txt("context_hour_utc"))


@query("rule_C04")
def _(m):
    files = K.file_counts(m.controls)
    return files.agg(F.sum("rows").alias("events_in"), F.sum(c("modellable") + c("repeats") + c("quarantined")).alias("partition")).withColumn(
        "lost", c("events_in") - c("partition"))


@query("set1_all_findings")
def _(m):
    return all_final(m).select(*FINDING_FIELDS)


@query("set2_duplicate_finding_ids")
def _(m):
    return all_final(m).agg(F.count("*").alias("findings"), F.count_distinct("finding_id").alias("ids"))


@query("set3_key_sets")
def _(m):
    a = FI.quarantine_keys(core_final(m))
    b = m.session_flags.where("is_quarantined").select("session_key")
    return a.exceptAll(b).withColumn("side", F.lit("findings only")).unionByName(b.exceptAll(a).withColumn("side", F.lit("flags only"))).groupBy("side").agg(F.count("*").alias("n"))


@query("set4_disjoint_populations")
def _(m):
    facts = m.facts
    keys = {n: M.select_population(facts, n, CFG).select("session_key") for n in (M.C_ELIGIBLE, M.E_OTHER)}
    shared = keys[M.C_ELIGIBLE].intersect(keys[M.E_OTHER]).agg(F.count("*").alias("shared"))
    return K.beside(shared, facts.agg(F.count("*").alias("all_sessions"), F.count_if(M.populations(CFG)[M.C_ELIGIBLE]).alias("eligible"),
                                      F.count_if(M.populations(CFG)[M.E_OTHER]).alias("other")))


@query("set5_added_members")
def _(m):
    return SC.members(bounded(m), tuple(s for s in REGISTRY if s.scenario_id in ("S00", "S01")), CFG).where("scenario_id = 'S01'").select("session_key", "weight")


# ---- builders -----------------------------------------------------------------------------------------------------------------------
@query("bld01_staged_events")
def _(m):
    return m.staged.select("event_id", "source_file", "source_row_number", "row_sha256", "population", "session_key", "tray_id", "scale_id", "component_raw",
                           "component", "weight_raw", "weight_g", "weight_status", "event_time_raw", txt("event_local"), txt("event_utc"), "event_time_status",
                           txt("ident_local"), txt("ident_utc"), "ident_time_status", "tz_handling")


@query("bld02_session_profiles")
def _(m):
    return m.profiles.select("session_key", "source_files", "events_staged", "events_counted", "repeats", txt("first_local"), txt("first_utc"), txt("last_utc"), "weight_counted")


@query("bld03_quarantine_keys")
def _(m):
    return FI.quarantine_keys(core_final(m))


@query("bld04_dispositions")
def _(m):
    return m.disposed.select("event_id", "disposition")


@query("bld05_final_findings")
def _(m):
    return FI.finalise(event_part(m), CFG).select("finding_id", "category", "severity", "handling", "quarantine")


@query("bld06_session_status")
def _(m):
    status = FI.session_rule_ids(FI.findings_by_session(core_final(m), m.session_flags))
    days = P.with_day_flags(m.session_flags, m.volume).select("session_key", "low_volume_day", "volume_irregularity")
    return days.join(status, "session_key", "left").na.fill("", ["error_rule_ids", "warn_rule_ids", "info_rule_ids"]).na.fill(
        False, ["has_session_warn", "has_event_warn"])


@query("bld06_session_status_direct")
def _(m):
    return m.sessions.select("session_key", "error_rule_ids", "warn_rule_ids", "info_rule_ids", "has_session_warn", "has_event_warn", "quarantine_rule_ids")


@query("bld07_event_status")
def _(m):
    status = FI.event_rule_ids(FI.finalise(event_part(m), CFG))
    return m.disposed.select("event_id", "disposition").join(status, "event_id", "left").na.fill("", ["error_rule_ids", "warn_rule_ids", "info_rule_ids"])


@query("bld08_quarantine_manifest")
def _(m):
    return FI.quarantine_manifest(core_final(m), m.disposed, m.session_flags)


@query("bld09_fact_event")
def _(m):
    blank = F.lit("")
    return m.fact_event.select("event_id", "session_key", "station_family", "component", "weight_g", txt("event_local"), txt("event_utc"), "disposition", "is_modellable",
                               "is_exact_duplicate", "quality_status", *[F.coalesce(n, blank).alias(n) for n in ("quarantine_rule_ids", "error_rule_ids", "warn_rule_ids", "info_rule_ids")])


@query("bld10_fact_session")
def _(m):
    blank = F.lit("")
    return m.fact_session.select(
        "session_key", "session_id", "population", "source_files", F.coalesce("tray_id", blank).alias("tray_id"), c("service_date").cast("string").alias("service_date"),
        txt("first_weighing_local"), txt("first_weighing_utc"), txt("last_weighing_utc"), txt("identification_local"), "span_s", r6("duration_minutes", "duration_minutes"),
        "event_count", "modellable_event_count", "duplicate_excluded_event_count", "quarantined_event_count", "selected_weight_g", "distinct_component_count",
        "distinct_raw_component_count", "component_count_status", "identity_conflict", "is_quarantined", F.coalesce("quarantine_rule_ids", blank).alias("quarantine_rule_ids"),
        "core_ready", "max_severity", "has_session_warn", "has_event_warn", "quality_status", txt("context_hour_utc"), "context_join_status", "context_matched")


@query("bld11_fact_component")
def _(m):
    return m.fact_component.select("session_key", "component", "raw_variants", "weighing_events", "scale_ids", "component_weight_g")


@query("bld12_fact_context")
def _(m):
    return m.context.select(txt("obs_utc"), "purchase_value", "purchase_status", "signup_value", "signup_status", "source_files")


@query("bld13_fact_daily_volume")
def _(m):
    return day_text(m.volume)


@query("bld14_validation_summary")
def _(m):
    final = all_final(m)
    parts = [final.groupBy(F.lit(kind).alias("kind"), c(col).alias("label")).agg(F.count("*").alias("n")) for kind, col in (("severity", "severity"), ("rule", "rule_id"), ("handling", "handling"))]
    live = m.sessions.where((c("population") == CFG.primary) & ~c("is_quarantined"))
    warn = live.select(F.lit("warn").alias("kind"), F.when(c("has_session_warn"), "session level").when(c("has_event_warn"), "event level only").otherwise("none").alias("label")).groupBy(
        "kind", "label").agg(F.count("*").alias("n"))
    return K.union_all([*parts, warn])


def working(m: Measurement) -> DataFrame:
    return SC.working_set(m.sessions, CFG)


def bounded(m: Measurement) -> DataFrame:
    """The working set with the scalars and day flags scenarios refer to: one row per session, read by every scenario."""
    return m.kept("working_set", lambda: SC.with_bounds(working(m), m.flagged, m.volume, CFG))


def scenario_results(m: Measurement, ids: tuple[str, ...] | None = None) -> DataFrame:
    registry = REGISTRY if ids is None else tuple(s for s in REGISTRY if s.scenario_id in ("S00", *ids))
    return SC.run_scenarios(bounded(m), registry, CFG)


@query("bld15_working_set")
def _(m):
    return working(m).select("session_key", "weight", "w_nonrepeat", "w_incl_repeats", "n_components", "n_raw_components", "n_scales", "modellable_event_count", "span_s",
                             *[f"tz_out_{h}" for h in range(5)])


def metric_text(df: DataFrame) -> DataFrame:
    return df.select("metric_id", "population", r6("value", "value"), "numerator", "denominator", "n_population", "n_used", "n_null_excluded", "status")


def metrics_of(m: Measurement, ids: tuple[str, ...] | None = None) -> DataFrame:
    facts = m.facts if ids and "S1" not in ids else m.facts_with_context
    return M.compute(facts, CFG, ids)


@query("bld16_evidence")
def _(m):
    return M.evidence_rows(metrics_of(m)).select("metric_id", "population", r6("value", "value"), "numerator", "denominator", "records_used", "records_excluded", "n_population", "status")


def validation_checks(m: Measurement) -> DataFrame:
    """The checks a measurement must pass: events, sessions, structure, names, time zones, repeats, context and weekday regimes."""
    days = RV.service_days(m.session_flags, CFG)
    parts = [K.event_checks(m.controls, pins(m), K.file_reconciliation(m.staged)), K.session_checks(m.staged, m.session_flags), K.structure_checks(m.staged),
             K.name_checks(m.staged, m.session_flags), K.timezone_checks(m.flagged, pins(m), file_part(m).where("rule_id = 'T10'"), CFG),
             K.duplicate_checks(m.flagged, m.session_flags, m.repeated_scales, R.natural_key_duplicates(m.staged, NATURAL_KEY)),
             K.context_checks(m.observations, context_part(m), declared_observations(m), CFG),
             K.volume_checks(days, RV.baseline_regimes(days, CFG), CFG)]
    return K.union_all([p.select("check_id", "area", "status") for p in parts])


@query("bld18_lane_status")
def _(m):
    return FI.lane_status(all_final(m), validation_checks(m))


# ---- metrics ------------------------------------------------------------------------------------------------------------------------
for _metric in ("M1", "M2", "M3", "M4", "M5", "S1", "S2", "S2D", "S3", "S4", "W1"):
    QUERIES[f"metric_{_metric}"] = lambda spark, sf_dir, metric=_metric: metric_text(metrics_of(measurement(spark, sf_dir), (metric,)))


@query("metric_all")
def _(m):
    return metric_text(metrics_of(m))


@query("metric_M3_by_date")
def _(m):
    return M.sessions_by_date(m.facts, CFG).select(c("service_date").cast("string").alias("service_date"), "sessions")


@query("metric_S1_detail")
def _(m):
    return M.context_detail(m.facts_with_context, CFG)


@query("metric_judge")
def _(m):
    results = metrics_of(m)
    contracts = [M.Contract("M1", M.D_CORE, 764.5, 0.0), M.Contract("M2", M.D_CORE, 2345.4, 0.05), M.Contract("M3", M.D_CORE, 1858, 0.0),
                 M.Contract("M4", M.C_ELIGIBLE, 2, 0.0), M.Contract("M5", M.D_CORE, 52.72, 0.005, (1858, 3524)), M.Contract("S2", M.C_ELIGIBLE, 14.78, 0.001, (1, 3524)),
                 M.Contract("W1", "n/a", None, 0.0)]
    return M.judge(results, M.contract_table(results, contracts)).select("metric_id", "verdict", "reasons")


@query("metric_sql_path")
def _(m):
    """The metrics as a Spark SQL user writes them, over a view of the session fact."""
    view = "session_fact"
    m.facts.createOrReplaceTempView(view)
    return m.spark.sql(f"""
        SELECT round(percentile(CASE WHEN core_ready THEN selected_weight_g END, 0.5), 6) AS m1,
               round(percentile(CASE WHEN core_ready THEN selected_weight_g END, 0.9), 6) AS m2,
               count_if(core_ready) AS m3, round(percentile(CASE WHEN core_ready THEN distinct_component_count END, 0.5), 6) AS m4,
               round(100.0D * count_if(core_ready) / count(*), 6) AS m5
        FROM {view} WHERE population = '{CFG.primary}'""")


# ---- checks -------------------------------------------------------------------------------------------------------------------------
CHECK_FIELDS = ("check_id", "expected", "observed", "status")


def pins(m: Measurement) -> DataFrame:
    """What the source declares: rows per file, counted before staging."""
    return m.raw.groupBy("source_file").agg(F.count("*").alias("pinned_rows"))


def declared_observations(m: Measurement) -> DataFrame:
    return m.raw_observations.groupBy("source_file").agg(F.count("*").alias("declared_rows"))


@query("check_E")
def _(m):
    return K.event_checks(m.controls, pins(m), K.file_reconciliation(m.staged)).select(*CHECK_FIELDS)


@query("check_S")
def _(m):
    return K.session_checks(m.staged, m.session_flags).select(*CHECK_FIELDS)


@query("check_F")
def _(m):
    return K.structure_checks(m.staged).select(*CHECK_FIELDS)


@query("check_N")
def _(m):
    return K.name_checks(m.staged, m.session_flags).select(*CHECK_FIELDS)


@query("check_Z")
def _(m):
    return K.timezone_checks(m.flagged, pins(m), file_part(m).where("rule_id = 'T10'"), CFG).select(*CHECK_FIELDS)


@query("check_D")
def _(m):
    return K.duplicate_checks(m.flagged, m.session_flags, m.repeated_scales, R.natural_key_duplicates(m.staged, NATURAL_KEY)).select(*CHECK_FIELDS)


@query("check_K")
def _(m):
    return K.context_checks(m.observations, context_part(m), declared_observations(m), CFG).select(*CHECK_FIELDS)


@query("check_V")
def _(m):
    days = RV.service_days(m.session_flags, CFG)
    return K.volume_checks(days, RV.baseline_regimes(days, CFG), CFG).select(*CHECK_FIELDS)


@query("check_M")
def _(m):
    quarantined = FI.quarantine_keys(FI.finalise(event_part(m).unionByName(session_part(m)), CFG))
    return K.model_checks(m.staged, m.controls, m.session_flags, m.facts_with_context, m.fact_component, m.context, m.volume,
                          RV.service_days(m.session_flags, CFG), quarantined, CFG).select(*CHECK_FIELDS)


@query("check_MC")
def _(m):
    return K.metric_checks(m.facts_with_context, m.disposed, m.controls, m.fact_component, m.context, m.volume, metrics_of(m), CFG).select(*CHECK_FIELDS)


@query("check_SC")
def _(m):
    results = scenario_results(m)
    return K.scenario_checks(results, SC.metric_deltas(results, REGISTRY), SC.baseline_check(results, metrics_of(m, SC.METRIC_ORDER)), working(m),
                             evidence(m), K.shifted_files(m.staged), REGISTRY, CFG).select(*CHECK_FIELDS)


@query("check_GRN")
def _(m):
    grains = {"context": (m.context, ["station", "obs_utc"]), "event": (m.staged, ["event_id"]), "session": (m.session_flags, ["session_key"]),
              "component": (m.fact_component, ["session_key", "component"]), "day": (m.volume, ["service_date", "population"])}
    return K.union_all([K.grain(df, keys).select(F.lit(name).alias("table_name"), "rows", "keys", "duplicated_keys") for name, (df, keys) in grains.items()])


# ---- scenarios ----------------------------------------------------------------------------------------------------------------------
SCENARIO_FIELDS = ("scenario_id", "m1", "m2", "m3", "m4", "m5_numerator", "m5_denominator", "m5", "s2_numerator", "s2")


def scenario_text(df: DataFrame) -> DataFrame:
    return df.select("scenario_id", "m3", "m5_numerator", "m5_denominator", "s2_numerator", *[r6(n, n) for n in ("m1", "m2", "m4", "m5", "s2")])


for _kind in SC.OPERATIONS:
    _ids = tuple(s.scenario_id for s in REGISTRY if s.operation["kind"] == _kind)
    QUERIES[f"scenario_{_kind}"] = lambda spark, sf_dir, ids=_ids: scenario_text(scenario_results(measurement(spark, sf_dir), ids)).where(c("scenario_id").isin(*ids))


@query("sen1_scenario_metrics")
def _(m):
    return scenario_text(scenario_results(m))


@query("sen2_deltas")
def _(m):
    return deltas(m).select("metric_id", "scenario_id", *[r6(n, n) for n in ("baseline_value", "scenario_value", "absolute_delta", "relative_delta")], "robustness_class")


@query("sen3_scenario_rows")
def _(m):
    results = scenario_results(m)
    rows = SC.scenario_rows(results, SC.metric_deltas(results, REGISTRY), REGISTRY)
    return rows.select("scenario_id", "m3", *[r6(f"{p}d_{x}", f"{p}d_{x}") for x in ("m1", "m2", "m3", "m4", "m5", "s2") for p in ("", "pct_")], "worst_class")


@query("sen4_ranges")
def _(m):
    return ranges_text(SC.scenario_ranges(deltas(m)))


@query("sen5_baseline")
def _(m):
    return SC.baseline_check(scenario_results(m, ()), metrics_of(m, SC.METRIC_ORDER)).select("metric_id", r6("scenario_value", "scenario_value"), "status")


@query("sen6_reference")
def _(m):
    # every scenario is held against the baseline's values: those that change nothing reproduce them
    results = scenario_results(m)
    base = results.where("scenario_id = 'S00'").select(F.explode(F.array(*[F.lit(s.scenario_id) for s in REGISTRY])).alias("scenario_id"), c("m1").alias("ref_m1"),
                                                       c("m2").alias("ref_m2"), c("m3").alias("ref_m3"), c("m4").alias("ref_m4"), c("m5_numerator").alias("ref_m5_numerator"))
    return SC.compare_with_reference(results, base, 0.05)


def evidence(m: Measurement) -> DataFrame:
    return TZ.timezone_evidence(m.disposed, working(m), m.context, CFG, "purchase", "signup")


@query("sen7_timezone_evidence")
def _(m):
    return evidence(m).withColumn("offset_hours", c("offset_hours").cast("bigint"))


@query("sen8_material_change")
def _(m):
    return SC.material_change(scenario_results(m), REGISTRY).select("scenario_id", F.coalesce(c("material_change").cast("string"), F.lit("")).alias("material_change"))


@query("sen9_questions")
def _(m):
    return SC.question_robustness(deltas(m))


PREVIEW = ("S10", "S20", "S21", "S08", "S04", "S01")


@query("sen10_preview")
def _(m):
    rows = SC.scenario_rows(scenario_results(m, PREVIEW), SC.metric_deltas(scenario_results(m, PREVIEW), REGISTRY), REGISTRY)
    return rows.select("scenario_id", "m3", r6("m1", "m1"), r6("m2", "m2"), r6("m4", "m4"), r6("d_m1", "d_m1"), r6("d_m2", "d_m2"))


# ---- the same shapes on the large table ---------------------------------------------------------------------------------------------
def lineitem_sessions(spark: SparkSession, sf_dir: str, names: bool = True) -> DataFrame:
    """Orders as sessions of line items: grams are quantities, names are part names, the population is the line status. Names are only
    joined and counted where they are wanted."""
    li = roles.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linestatus", c("l_quantity").cast("bigint").alias("g"))
    sums = [F.count("*").alias("events"), S.strict_sum(c("g")).alias("weight")]
    if names:
        part = roles.table(spark, sf_dir, "part").select(c("p_partkey").alias("l_partkey"), X.norm_name(c("p_name")).alias("component"))
        li, sums = li.join(part, "l_partkey"), [*sums, F.count_distinct("component").alias("components")]
    per = li.groupBy("l_orderkey", "l_linestatus").agg(*sums)
    crossing = F.count("*").over(Window.partitionBy("l_orderkey")) > 1
    return per.withColumn("crossover", crossing)


@table_query("lineitem_session_metrics")
def _(spark, sf_dir):
    s = lineitem_sessions(spark, sf_dir)
    live = ~c("crossover")
    counted = s.groupBy("l_linestatus", "crossover", "weight", "components").agg(F.count("*").alias("n"))
    return counted.groupBy("l_linestatus").agg(
        F.sum("n").alias("eligible"), F.sum(F.when(live, c("n"))).alias("ready"),
        r6(S.exact_percentile(F.when(live, c("weight")), 0.5, c("n")), "m1"), r6(S.exact_percentile(F.when(live, c("weight")), 0.9, c("n")), "m2"),
        r6(S.exact_percentile(F.when(live, c("components")), 0.5, c("n")), "m4"))


@table_query("lineitem_daily_volume")
def _(spark, sf_dir):
    s = lineitem_sessions(spark, sf_dir, names=False)
    orders = roles.table(spark, sf_dir, "orders").select(c("o_orderkey").alias("l_orderkey"), c("o_orderdate").cast("date").alias("day"))
    return s.join(orders, "l_orderkey").groupBy(c("day").cast("string").alias("day"), "l_linestatus").agg(
        F.count_if(~c("crossover")).alias("sessions"), F.count_if("crossover").alias("crossing"), F.sum("events").alias("events"))
