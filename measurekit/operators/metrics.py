"""Metrics over named populations, and their comparison with a contract. Denominators are fixed before anything is removed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from measurekit.config import Config
from measurekit.functions import stats as S

A_ALL, B_MODELLED, C_ELIGIBLE, D_CORE, E_OTHER = (
    "all_observed", "non_quarantined_modelled", "eligible_primary", "core_ready_primary", "other_population")


def populations(cfg: Config) -> dict[str, Column]:
    c = F.col
    primary = c("population") == cfg.primary
    return {
        A_ALL: F.lit(True),
        B_MODELLED: ~c("is_quarantined") & (c("modellable_event_count") > 0),
        C_ELIGIBLE: primary,
        D_CORE: primary & c("core_ready"),
        E_OTHER: c("population") == cfg.other,
    }


def select_population(facts: DataFrame, name: str, cfg: Config) -> DataFrame:
    """The sessions of a named population; an unknown name is refused."""
    return facts.where(populations(cfg)[name])


def non_null(df: DataFrame, column: str) -> DataFrame:
    """Rows in all, rows used and rows left out because the value is NULL. NULL is counted, never read as zero."""
    return df.agg(F.count("*").alias("n_population"), F.count(column).alias("n_used"), F.count_if(F.col(column).isNull()).alias("n_null_excluded"))


def metric_columns(cfg: Config) -> dict[str, dict[str, Column]]:
    """Metric id -> the columns of its row, all aggregates of one pass over the session fact."""
    pop = populations(cfg)
    core, eligible, other = pop[D_CORE], pop[C_ELIGIBLE], pop[E_OTHER]
    c = F.col
    weight = F.when(core, c("selected_weight_g"))
    components = F.when(core, c("distinct_component_count"))
    n_core, n_eligible = F.count_if(core), F.count_if(eligible)
    none_long, none_double = F.lit(None).cast("bigint"), F.lit(None).cast("double")

    def statistic(population: str, value: Column, used: Column, total: Column) -> dict[str, Column]:
        return {"population": F.lit(population), "value": value.cast("double"), "numerator": none_long, "denominator": none_long,
                "n_population": total, "n_used": F.count(used), "n_null_excluded": total - F.count(used)}

    def ratio(population: str, cond: Column, label: str = "") -> dict[str, Column]:
        n = F.count_if(cond)
        return {"population": F.lit(label or population), "value": S.percent(n, n_eligible), "numerator": n, "denominator": n_eligible,
                "n_population": n_eligible, "n_used": n, "n_null_excluded": F.lit(0).cast("bigint")}

    other_weight = F.when(other & ~c("is_quarantined"), c("selected_weight_g"))
    out = {
        "M1": statistic(D_CORE, S.exact_median(weight), weight, n_core),
        "M2": statistic(D_CORE, S.exact_percentile(weight, 0.9), weight, n_core),
        "M3": statistic(D_CORE, n_core, F.when(core, F.lit(1)), n_core),
        "M4": statistic(D_CORE, S.exact_median(components), components, n_core),
        "M5": ratio(C_ELIGIBLE, core, D_CORE),
        "S1": ratio(C_ELIGIBLE, eligible & c("context_matched")),
        "S2": ratio(C_ELIGIBLE, core & ~c("has_session_warn")),
        "S2D": ratio(C_ELIGIBLE, core & ~c("has_session_warn") & ~c("has_event_warn")),
        "S3": statistic(D_CORE, S.exact_percentile(weight, 0.9) - S.exact_percentile(weight, 0.1), weight, n_core),
        "S4": statistic(E_OTHER, S.exact_median(other_weight), other_weight, F.count_if(other)),
        "W1": {"population": F.lit("n/a"), "value": none_double, "numerator": none_long, "denominator": none_long,
               "n_population": F.lit(0).cast("bigint"), "n_used": F.lit(0).cast("bigint"), "n_null_excluded": F.lit(0).cast("bigint")},
    }
    for metric, cols in out.items():
        cols["status"] = F.lit("BLOCKED" if metric == "W1" else "READY")
    return out


METRIC_FIELDS = ("population", "value", "numerator", "denominator", "n_population", "n_used", "n_null_excluded", "status")


def compute(facts: DataFrame, cfg: Config, metrics: tuple[str, ...] | None = None) -> DataFrame:
    """One row per metric from one aggregate over the session fact (which must carry the context join for S1)."""
    wanted = {m: cols for m, cols in metric_columns(cfg).items() if metrics is None or m in metrics}
    one = facts.agg(*[F.struct(F.lit(m).alias("metric_id"), *[cols[f].alias(f) for f in METRIC_FIELDS]).alias(m) for m, cols in wanted.items()])
    return one.select(F.inline(F.array(*[F.col(m) for m in wanted])))


def sessions_by_date(facts: DataFrame, cfg: Config) -> DataFrame:
    """M3 per service date."""
    return (select_population(facts, D_CORE, cfg).where(F.col("service_date").isNotNull())
            .groupBy("service_date").agg(F.count("*").alias("sessions")))


def component_distribution(facts: DataFrame, cfg: Config) -> DataFrame:
    """M4's distribution."""
    return (select_population(facts, D_CORE, cfg).where(F.col("distinct_component_count").isNotNull())
            .groupBy("distinct_component_count").agg(F.count("*").alias("sessions")))


def context_detail(facts: DataFrame, cfg: Config) -> DataFrame:
    """S1's join-status counts, with the matched sessions whose hour has a NULL value."""
    nulls = [name for name in facts.columns if name.endswith("_null")]
    return (select_population(facts, C_ELIGIBLE, cfg).groupBy("context_join_status")
            .agg(F.count("*").alias("sessions"),
                 *[F.count_if(F.col("context_matched") & F.col(n)).alias(f"{n}_sessions") for n in nulls]))


@dataclass(frozen=True)
class Contract:
    """What a metric is held to."""

    metric_id: str
    population: str
    approved_value: float | None
    tolerance: float
    counts: tuple[int, int] | None = None


def contract_table(df: DataFrame, contracts: list[Contract]) -> DataFrame:
    rows = [(k.metric_id, k.population, None if k.approved_value is None else float(k.approved_value), float(k.tolerance), *(k.counts or (None, None))) for k in contracts]
    return df.sparkSession.createDataFrame(
        rows, "metric_id string, contract_population string, approved_value double, tolerance double, approved_num bigint, approved_den bigint")


def judge(results: DataFrame, contracts: DataFrame) -> DataFrame:
    """PASS or FAIL with reasons: wrong population, no value, value outside the tolerance, counts that differ."""
    c = F.col
    missing = c("approved_value").isNull() | c("value").isNull()
    off = F.abs(c("value") - c("approved_value")) > c("tolerance")
    counts = c("approved_num").isNotNull() & ~(c("numerator").eqNullSafe(c("approved_num")) & c("denominator").eqNullSafe(c("approved_den")))
    reasons = F.array_compact(F.array(
        F.when(missing, "no value to judge"),
        F.when(c("population") != c("contract_population"), "population is not the contract's"),
        F.when(~missing & off, "value outside tolerance"),
        F.when(~missing & counts, "counts differ")))
    joined = results.join(contracts, "metric_id", "inner")
    return joined.select("metric_id", "population", "value", "approved_value", F.array_join(reasons, "; ").alias("reasons"),
                         F.when(F.size(reasons) == 0, "PASS").otherwise("FAIL").alias("verdict"))


def evidence_rows(results: DataFrame) -> DataFrame:
    """Per metric: value, records used and records left out of the fixed population."""
    return results.select("metric_id", "population", "value", "numerator", "denominator",
                          F.col("n_used").alias("records_used"), (F.col("n_population") - F.col("n_used")).alias("records_excluded"),
                          "n_population", "status")


def portioning_by_scale(events: DataFrame, facts: DataFrame, cfg: Config) -> DataFrame:
    """Per scale, over modellable events of core-ready sessions: events, median, P90, large-weight flags and their rate.

    Weights are whole grams, so the exact percentiles work on value counts; they are combined per (scale, weight) first.
    """
    from measurekit.functions import text as X

    c = F.col
    core = select_population(facts, D_CORE, cfg).select("session_key")
    rows = events.where((c("disposition") == "MODELLABLE") & c("weight_g").isNotNull()).join(core, "session_key", "left_semi")
    counted = rows.groupBy("scale_id", "weight_g").agg(F.count("*").alias("n"), F.count_if("hit_B02").alias("heavy"))
    return (counted.groupBy("scale_id")
            .agg(F.sum("n").alias("events"),
                 F.round(S.exact_percentile(c("weight_g"), 0.5, c("n")), 1).alias("median_weight_g"),
                 F.round(S.exact_percentile(c("weight_g"), 0.9, c("n")), 1).alias("p90_weight_g"),
                 F.sum("heavy").alias("heavy_events"))
            .select("scale_id", X.station_family(c("scale_id")).alias("station_family"), X.scale_kind_label(c("scale_id"), cfg.scale_kinds).alias("kind"),
                    "events", "median_weight_g", "p90_weight_g", "heavy_events",
                    F.round(100 * c("heavy_events") / c("events"), 2).alias("heavy_rate_pct")))
