"""What-if scenarios over one working set, in one aggregate.

A scenario is data: who stays, which weight counts, which component count counts. Each becomes a struct on the session row, and
`inline` turns a row into one row per scenario it stays in. Every scenario is then a group of a single aggregate; the session
table is read once, whatever the number of scenarios.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from measurekit.config import Config
from measurekit.functions import stats as S
from measurekit.operators.facts import fact_session

KPIS = ("M1", "M2", "M3", "M4")
WITH_READINESS = (*KPIS, "M5", "S2")
METRIC_ORDER = ("M1", "M2", "M3", "M4", "M5", "S2")
NOT_CLASSIFIED = "NOT_CLASSIFIED"

# Metric, how the change is measured, stable below, sensitive below.
BANDS = (
    ("M1", "absolute", 10.0, 20.0),
    ("M2", "absolute", 25.0, 75.0),
    ("M3", "relative", 0.05, 0.20),
    ("M4", "absolute", 0.5, 1.5),
    ("M5", "absolute", 0.5, 5.0),
    ("S2", "absolute", 0.5, 5.0),
)
CLASSES = ("STABLE", "SENSITIVE", "CONDITIONAL", "BLOCKED")


@dataclass(frozen=True)
class Scenario:
    scenario_id: str
    group: str
    operation: dict
    metrics: tuple[str, ...] = KPIS
    defensible: bool = True
    comparable: bool = True         # False: reported, never classified or ranged


def default_registry(cfg: Config, week: tuple[dt.date, dt.date], period_start: dt.date) -> tuple[Scenario, ...]:
    """The scenario space: crossover, outliers, time zone of the corrected file, volume, definitions, population.

    S02 and S03 split the crossover sessions of S01 by whether their two versions are identical.
    """
    s = Scenario
    return (
        s("S00", "baseline", {"kind": "baseline"}, WITH_READINESS),
        s("S01", "crossover", {"kind": "include", "which": "all"}, WITH_READINESS, False),
        s("S02", "crossover", {"kind": "include", "which": "identical"}, WITH_READINESS, False),
        s("S03", "crossover", {"kind": "include", "which": "conflicting"}, WITH_READINESS, False),
        s("S04", "outlier", {"kind": "exclude_session"}),
        s("S05", "outlier", {"kind": "drop_event"}),
        s("S06", "outlier", {"kind": "exclude_weight_outside", "method": "percentile", "lo": 0.005, "hi": 0.995}),
        s("S07", "outlier", {"kind": "exclude_weight_outside", "method": "threshold"}),
        s("S08", "outlier", {"kind": "exclude_where", "field": "modellable_event_count", "op": "<=", "value": 1}),
        s("S09", "outlier", {"kind": "exclude_where", "field": "span_s", "op": cfg.session_span.operator, "value": cfg.session_span.value}),
        s("S10", "outlier", {"kind": "exclude_where_any_warn"}),
        *[s(f"TZ{h}", "timezone", {"kind": "timezone_shift", "hours": h}, WITH_READINESS, h >= 2) for h in range(5)],
        s("S20", "volume", {"kind": "exclude_dates", "set": "irregular"}),
        s("S21", "volume", {"kind": "exclude_dates", "from": week[0], "to": week[1]}),
        s("S22", "volume", {"kind": "exclude_dates", "set": "low"}),
        s("S23", "period", {"kind": "exclude_dates", "before": period_start}),
        s("S30", "definition", {"kind": "m4_definition", "definition": "raw_names"}, ("M4",)),
        s("S31", "definition", {"kind": "m4_definition", "definition": "scales"}, ("M4",)),
        s("S32", "definition", {"kind": "m4_definition", "definition": "events"}, ("M4",)),
        s("S33", "definition", {"kind": "weight_definition"}, KPIS, False),
        s("S40", "population", {"kind": "population"}, KPIS, False, False),
        s("G01", "guardrail", {"kind": "pooled"}, KPIS, False, False),
    )


def check_registry(registry: tuple[Scenario, ...]) -> None:
    ids = [s.scenario_id for s in registry]
    if len(set(ids)) != len(ids):
        raise ValueError("scenario ids are not unique")
    if [s.scenario_id for s in registry if s.operation["kind"] == "baseline"] != ["S00"]:
        raise ValueError("exactly one scenario, S00, is the baseline")
    for s in registry:
        if s.operation["kind"] not in OPERATIONS:
            raise ValueError(f"unknown operation kind {s.operation['kind']!r}")
        if s.operation["kind"] == "pooled" and (s.comparable or s.defensible):
            raise ValueError(f"{s.scenario_id}: pooled figures mix populations, so they get no class and no range")


def largest_event(events: DataFrame) -> DataFrame:
    """One row: the heaviest event with its session; equal weights are settled by the event id."""
    pick = F.max(F.struct(F.col("weight_g"), F.col("event_id"), F.col("session_key")))
    return (events.where("weight_g is not null").agg(pick.alias("e"))
            .select("e.event_id", "e.session_key", F.col("e.weight_g").alias("weight_g")))


def working_set(sessions: DataFrame, cfg: Config) -> DataFrame:
    """Per session, everything a scenario may need, from the session status alone."""
    c = F.col
    extra = ("weight_all", "weight_counted", "n_components", "n_raw_components", "n_scales", "identical", "override_events", "override_first_wall",
             *[f"tz_out_{h}" for h in range(5)])
    return fact_session(sessions, cfg, extra=extra).select(
        "session_key", "session_id", "population", "service_date", "is_quarantined", "core_ready", "span_s", "has_session_warn",
        "has_event_warn", "identity_conflict", c("selected_weight_g").alias("weight"),
        F.when(c("is_quarantined"), c("weight_all")).otherwise(c("weight_counted")).alias("w_nonrepeat"), c("weight_all").alias("w_incl_repeats"),
        "modellable_event_count", *[n for n in extra if not n.startswith("weight_")])


def with_bounds(ws: DataFrame, events: DataFrame, days: DataFrame, cfg: Config, lo: float = 0.005, hi: float = 0.995) -> DataFrame:
    """Attach the few scalars scenarios refer to: percentile bounds of the baseline, the largest event, and day flags.

    The scalars are one row each and ride along on a constant key; days are joined on the service date.
    """
    c = F.col
    base = c("core_ready") & (c("population") == cfg.primary)
    bounds = ws.where(base).agg(S.exact_percentile(c("weight"), lo).alias("p_lo"), S.exact_percentile(c("weight"), hi).alias("p_hi"))
    top = largest_event(events).select(c("session_key").alias("top_key"), c("weight_g").alias("top_weight"))
    one = F.lit(1).alias("one")
    scalars = (bounds.select(one, "p_lo", "p_hi").join(top.select(one, "top_key", "top_weight"), "one", "left"))
    flags = days.where(c("population") == cfg.primary).select("service_date", "low_volume_day", "volume_irregularity")
    return (ws.withColumn("one", F.lit(1)).join(F.broadcast(scalars), "one", "left").drop("one")      # one row
            .join(flags, "service_date", "left"))


# ---- operations: each gives (keep, weight, components) for the session row -------------------------------------------------------
Rule = tuple[Column, Column, Column]


def _include(base: Rule, op: dict, cfg: Config) -> Rule:
    keep, weight, comps = base
    c = F.col
    added = (c("population") == cfg.primary) & c("is_quarantined")
    if op["which"] == "identical":
        added = added & F.coalesce(c("identical"), F.lit(False))
    elif op["which"] == "conflicting":
        added = added & F.coalesce(~c("identical"), F.lit(False))
    elif op["which"] != "all":
        raise ValueError(f"unknown selection {op['which']!r}")
    return keep | added, F.when(added, c("w_nonrepeat")).otherwise(weight), comps


def _exclude_weight(base: Rule, op: dict, cfg: Config) -> Rule:
    keep, weight, comps = base
    if op["method"] == "percentile":
        inside = F.col("weight").between(F.col("p_lo"), F.col("p_hi"))
    elif op["method"] == "threshold":
        inside = F.col("weight").between(*[F.lit(b) for b in cfg.session_weight])
    else:
        raise ValueError(f"unknown bound method {op['method']!r}")
    return keep & F.coalesce(inside, F.lit(False)), weight, comps


def _exclude_where(base: Rule, op: dict, cfg: Config) -> Rule:
    from measurekit.config import Threshold

    keep, weight, comps = base
    if op["field"] not in ("modellable_event_count", "span_s"):
        raise ValueError(f"unknown field {op['field']!r}")
    hit = S.compare(F.col(op["field"]), Threshold(op["op"], op["value"]))
    return keep & ~F.coalesce(hit, F.lit(False)), weight, comps


def date_selector(op: dict) -> Column:
    """Sessions of a day set, before a day, or from one day to another. No date, no match."""
    d = F.col("service_date")
    if "set" in op:
        flags = {"irregular": "volume_irregularity", "low": "low_volume_day"}
        if op["set"] not in flags:
            raise ValueError(f"unknown day set {op['set']!r}")
        return F.coalesce(F.col(flags[op["set"]]), F.lit(False))
    if "before" in op:
        return F.coalesce(d < F.lit(op["before"]), F.lit(False))
    if "from" in op:
        return F.coalesce(d.between(F.lit(op["from"]), F.lit(op["to"])), F.lit(False))
    raise ValueError(f"unknown date selector {op}")


def _m4(base: Rule, op: dict, cfg: Config) -> Rule:
    picks = {"raw_names": "n_raw_components", "scales": "n_scales", "events": "modellable_event_count"}
    if op["definition"] not in picks:
        raise ValueError(f"unknown component definition {op['definition']!r}")
    return base[0], base[1], F.col(picks[op["definition"]])


def _live_other(cfg: Config) -> Column:
    return (F.col("population") == cfg.other) & ~F.col("is_quarantined") & F.col("weight").isNotNull()


OPERATIONS: dict[str, Callable[[Rule, dict, Config], Rule]] = {
    "baseline": lambda b, op, cfg: b,
    "include": _include,
    "exclude_session": lambda b, op, cfg: (b[0] & ~F.col("session_key").eqNullSafe(F.col("top_key")), b[1], b[2]),
    "drop_event": lambda b, op, cfg: (
        b[0], F.when(F.col("session_key").eqNullSafe(F.col("top_key")), b[1] - F.col("top_weight")).otherwise(b[1]), b[2]),
    "exclude_weight_outside": _exclude_weight,
    "exclude_where": _exclude_where,
    "exclude_where_any_warn": lambda b, op, cfg: (b[0] & ~(F.col("has_session_warn") | F.col("has_event_warn")), b[1], b[2]),
    "timezone_shift": lambda b, op, cfg: (b[0] & ~F.col(f"tz_out_{op['hours']}"), b[1], b[2]),
    "exclude_dates": lambda b, op, cfg: (b[0] & ~date_selector(op), b[1], b[2]),
    "m4_definition": _m4,
    "weight_definition": lambda b, op, cfg: (b[0], F.col("w_incl_repeats"), b[2]),
    "population": lambda b, op, cfg: (_live_other(cfg), b[1], b[2]),
    "pooled": lambda b, op, cfg: (b[0] | _live_other(cfg), b[1], b[2]),
}


def members(ws: DataFrame, registry: tuple[Scenario, ...], cfg: Config) -> DataFrame:
    """(scenario, session) rows: each session row unfolds into the scenarios it stays in."""
    check_registry(registry)
    c = F.col
    base: Rule = (c("core_ready") & (c("population") == cfg.primary), c("weight"), c("n_components"))
    structs = []
    for s in registry:
        keep, weight, comps = OPERATIONS[s.operation["kind"]](base, s.operation, cfg)
        structs.append(F.when(keep, F.struct(
            F.lit(s.scenario_id).alias("scenario_id"), weight.alias("weight"), comps.alias("components"),
            (~c("has_session_warn")).alias("warn_free"))))
    return ws.select("session_key", F.inline(F.array_compact(F.array(*structs))))


def run_scenarios(ws: DataFrame, registry: tuple[Scenario, ...], cfg: Config) -> DataFrame:
    """M1 to M4 of every scenario, and M5 and S2 over the fixed denominator where the scenario defines them.

    (scenario, weight, components) combinations are counted first: the counts combine before the shuffle, and the exact
    percentiles then work on distinct whole grams instead of on sessions.
    """
    c = F.col
    counted = (members(ws, registry, cfg).groupBy("scenario_id", "weight", "components")
               .agg(F.count("*").alias("n"), F.count_if("warn_free").alias("warn_free")))
    eligible = ws.agg(F.count_if(c("population") == cfg.primary).alias("eligible")).withColumn("one", F.lit(1))
    out = counted.groupBy("scenario_id").agg(
        F.sum("n").alias("m3"),
        S.exact_percentile(c("weight"), 0.5, c("n")).alias("m1"), S.exact_percentile(c("weight"), 0.9, c("n")).alias("m2"),
        S.exact_percentile(c("components"), 0.5, c("n")).alias("m4"), F.sum("warn_free").alias("warn_free"))
    # a scenario that nobody stays in has no statistics and so no row; check SC01 then fails
    declared = registry_table(ws, registry).select("scenario_id", F.array_contains("metrics", F.lit("M5")).alias("has_m5"), F.lit(1).alias("one"))
    # the registry has a row per declared scenario, `eligible` has one row
    joined = out.join(F.broadcast(declared), "scenario_id").join(F.broadcast(eligible), "one")
    return joined.select(
        "scenario_id", "m1", "m2", "m3", "m4",
        F.when(c("has_m5"), c("m3")).alias("m5_numerator"), F.when(c("has_m5"), c("eligible")).alias("m5_denominator"),
        F.when(c("has_m5"), S.percent(c("m3"), c("eligible"))).alias("m5"),
        F.when(c("has_m5"), c("warn_free")).alias("s2_numerator"), F.when(c("has_m5"), S.percent(c("warn_free"), c("eligible"))).alias("s2"))


def delta(value: Column, baseline: Column) -> Column:
    return value - baseline


def relative_delta(value: Column, baseline: Column) -> Column:
    """Change as a fraction of the baseline; 0 where the baseline is 0."""
    return F.when(baseline == 0, F.lit(0.0)).otherwise((value - baseline) / baseline)


def classify(metric: Column, baseline: Column, value: Column) -> Column:
    """STABLE | SENSITIVE | CONDITIONAL by the band of the metric; BLOCKED without both values."""
    out = F.lit("BLOCKED")
    for name, kind, stable, sensitive in BANDS:
        size = F.abs(delta(value, baseline) if kind == "absolute" else relative_delta(value, baseline))
        ladder = F.when(size < stable, "STABLE").when(size < sensitive, "SENSITIVE").otherwise("CONDITIONAL")
        out = F.when(metric == name, ladder).otherwise(out)
    return F.when(baseline.isNull() | value.isNull(), "BLOCKED").otherwise(out)


def class_rank(robustness: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in CLASSES]), robustness)


def worst_class(robustness: Column) -> Column:
    """Most severe class of a group."""
    return F.max_by(robustness, class_rank(robustness))


def registry_table(df: DataFrame, registry: tuple[Scenario, ...]) -> DataFrame:
    rows = [(i, s.scenario_id, s.group, s.defensible, s.comparable, list(s.metrics)) for i, s in enumerate(registry)]
    return df.sparkSession.createDataFrame(
        rows, "position int, scenario_id string, scenario_group string, defensible boolean, comparable boolean, metrics array<string>")


def metric_deltas(results: DataFrame, registry: tuple[Scenario, ...]) -> DataFrame:
    """One row per metric and scenario that defines it, against the baseline of the same metric."""
    c = F.col
    stack = F.inline(F.array(*[F.struct(F.lit(m).alias("metric_id"), c(m.lower()).cast("double").alias("scenario_value")) for m in METRIC_ORDER]))
    reg = F.broadcast(registry_table(results, registry))        # one row per declared scenario
    long = results.join(reg, "scenario_id").select("scenario_id", "scenario_group", "defensible", "comparable", "metrics", stack)
    # a metric has one row per declared scenario, so its window holds a few dozen rows
    baseline = F.max(F.when(c("scenario_id") == "S00", c("scenario_value"))).over(Window.partitionBy("metric_id"))
    joined = long.where(F.array_contains("metrics", c("metric_id"))).withColumn("baseline_value", baseline)
    b, v = c("baseline_value"), c("scenario_value")
    return joined.select(
        "metric_id", "scenario_id", "scenario_group", "defensible", "comparable", "baseline_value", "scenario_value",
        delta(v, b).alias("absolute_delta"), relative_delta(v, b).alias("relative_delta"),
        F.when(c("comparable"), classify(c("metric_id"), b, v)).otherwise(NOT_CLASSIFIED).alias("robustness_class"))


def scenario_rows(results: DataFrame, deltas: DataFrame, registry: tuple[Scenario, ...]) -> DataFrame:
    """One row per scenario with the change of every metric, in value and percent, and its worst class."""
    c = F.col
    cols = []
    for m in METRIC_ORDER:
        mine = c("metric_id") == m
        cols += [F.max(F.when(mine, c("absolute_delta"))).alias(f"d_{m.lower()}"),
                 F.max(F.when(mine, 100 * c("relative_delta"))).alias(f"pct_d_{m.lower()}")]
    rated = ~c("robustness_class").isin(NOT_CLASSIFIED, "BLOCKED")
    wide = deltas.groupBy("scenario_id").agg(
        *cols, F.coalesce(worst_class(F.when(rated, c("robustness_class"))), F.lit(NOT_CLASSIFIED)).alias("worst_class"))
    return results.join(wide, "scenario_id")


def scenario_ranges(deltas: DataFrame) -> DataFrame:
    """Per metric: range over comparable scenarios and over defensible ones, and the scenarios that move it most."""
    c = F.col
    ok = deltas.where("comparable")
    d = c("defensible")
    def top(by: str) -> Column:
        return F.max_by("scenario_id", F.struct(F.abs(c(by)), c("scenario_id")))

    return ok.groupBy("metric_id").agg(
        F.min("scenario_value").alias("min_value"), F.max("scenario_value").alias("max_value"), F.count("*").alias("scenarios"),
        F.min(F.when(d, c("scenario_value"))).alias("defensible_min"), F.max(F.when(d, c("scenario_value"))).alias("defensible_max"),
        F.count_if(d).alias("defensible_scenarios"), top("absolute_delta").alias("largest_absolute"), top("relative_delta").alias("largest_relative"))


def material_change(results: DataFrame, registry: tuple[Scenario, ...]) -> DataFrame:
    """A change of at least 10 g in M1, 25 g in M2, or any change in M4; not judged for population contrasts."""
    c = F.col
    reg = F.broadcast(registry_table(results, registry).select("scenario_id", "comparable"))        # one row per declared scenario
    every = Window.partitionBy(F.lit(1))        # the result rows: one per scenario

    def base(metric: str) -> Column:
        return F.max(F.when(c("scenario_id") == "S00", c(metric))).over(every)

    joined = results.withColumns({"b1": base("m1"), "b2": base("m2"), "b4": base("m4")}).join(reg, "scenario_id")
    hit = (F.abs(c("m1") - c("b1")) >= 10) | (F.abs(c("m2") - c("b2")) >= 25) | (F.abs(c("m4") - c("b4")) > 0)
    return joined.select("scenario_id", F.when(c("comparable"), hit).alias("material_change"))


@dataclass(frozen=True)
class Question:
    question_id: str
    metrics: tuple[str, ...]
    scenarios: tuple[str, ...] = ()      # empty: every comparable scenario


QUESTIONS = (
    Question("Q_weight", ("M1", "M2"), ()),
    Question("Q_components", ("M4",), ("S30", "S31", "S32")),
    Question("Q_crossover", ("M1", "M2", "M3", "M4"), ("S01", "S02", "S03")),
    Question("Q_timezone", ("M1", "M2", "M3", "M5"), ("TZ0", "TZ1", "TZ2", "TZ3", "TZ4")),
    Question("Q_volume", ("M1", "M2", "M4"), ("S20", "S21", "S22", "S23")),
    Question("Q_readiness", ("M5", "S2"), ()),
)


def question_robustness(deltas: DataFrame, questions: tuple[Question, ...] = QUESTIONS) -> DataFrame:
    """Worst class over the metric and scenario cells of a question, with the cell that drives it."""
    c = F.col
    asked = deltas.where(c("comparable") & (c("scenario_id") != "S00"))
    belongs = [F.when(c("metric_id").isin(*q.metrics) & (c("scenario_id").isin(*q.scenarios) if q.scenarios else F.lit(True)),
                      F.lit(q.question_id)) for q in questions]
    cells = asked.select("*", F.explode(F.array_compact(F.array(*belongs))).alias("question_id"))
    order = F.struct(class_rank(c("robustness_class")), F.round(F.abs(c("relative_delta")), 9), c("metric_id"), c("scenario_id"))
    return cells.groupBy("question_id").agg(
        worst_class(c("robustness_class")).alias("robustness"), F.count("*").alias("cells"),
        F.max_by(F.concat_ws(" in ", "metric_id", "scenario_id"), order).alias("driver"))


def compare_with_reference(results: DataFrame, reference: DataFrame, tolerance: float) -> DataFrame:
    """Scenario results against approved ones: grams within the tolerance, counts exactly."""
    c = F.col
    off = (F.abs(c("m1") - c("ref_m1")) > tolerance) | (F.abs(c("m2") - c("ref_m2")) > tolerance) | (c("m3") != c("ref_m3")) | (
        c("m4") != c("ref_m4")) | F.coalesce(c("m5_numerator") != c("ref_m5_numerator"), F.lit(False))
    return results.join(reference, "scenario_id").select(
        "scenario_id", F.when(F.coalesce(off, F.lit(True)), "MISMATCH").otherwise("reproduced").alias("reference_status"))


def baseline_check(results: DataFrame, metrics: DataFrame) -> DataFrame:
    """The baseline scenario against the independent metric computation, to 1e-9."""
    c = F.col
    base = results.where("scenario_id = 'S00'").select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric_id"), c(m.lower()).cast("double").alias("scenario_value")) for m in METRIC_ORDER])))
    return base.join(metrics.select("metric_id", c("value").alias("metric_value")), "metric_id").select(
        "metric_id", "scenario_value", "metric_value",
        F.when(F.abs(c("scenario_value") - c("metric_value")) <= 1e-9, "PASS").otherwise("FAIL").alias("status"))
