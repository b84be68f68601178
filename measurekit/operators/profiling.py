"""Profiling operators: what the data looks like before any rule judges it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from measurekit.config import Config
from measurekit.functions import stats as S
from measurekit.functions import text as X
from measurekit.functions import times as T
from measurekit.operators.quantiles import ranked_percentiles, value_counts
from measurekit.operators.ranges import MOST, lagged, range_blocks, value_ranges


# ---- aggregates ---------------------------------------------------------------------------------------------------------------------
def count_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def field_completeness(staged: DataFrame) -> DataFrame:
    """Per field: rows, rows whose file lacks the column, empty rows, malformed rows. Missing, absent and malformed stay apart.

    One aggregate per file, then a sum over files: whether a file has the optional column is known per file.
    """
    c = F.col

    def empty(name: str) -> Column:
        return X.strip(c(name)) == ""

    fields = {
        "session_id": (empty("session_id"), F.lit(False)), "tray_id": (empty("tray_id"), F.lit(False)),
        "scale_id": (empty("scale_id"), F.lit(False)), "component_name": (empty("component_raw"), F.lit(False)),
        "weight": (c("weight_status") == "EMPTY", c("weight_status") == "NOT_INTEGER"),
        "event_time": (empty("event_time_raw"), ~empty("event_time_raw") & (c("event_time_status") != "OK")),
        "identification_time": (empty("ident_time_raw"), ~empty("ident_time_raw") & (c("ident_time_status") != "OK")),
        "weighing_type": (c("weighing_type").isNull(), F.lit(False)),
    }
    per_file = staged.groupBy("source_file").agg(
        F.count("*").alias("rows"), F.count("weighing_type").alias("typed"),
        *[F.count_if(e).alias(f"{f}_empty") for f, (e, _) in fields.items()],
        *[F.count_if(b).alias(f"{f}_bad") for f, (_, b) in fields.items()])
    lacks = c("typed") == 0
    stack = F.inline(F.array(*[F.struct(
        F.lit(f).alias("field"), c("rows"),
        (F.when(lacks, c("rows")).otherwise(0) if f == "weighing_type" else F.lit(0)).cast("bigint").alias("not_applicable_rows"),
        (F.when(lacks, 0).otherwise(c(f"{f}_empty")) if f == "weighing_type" else c(f"{f}_empty")).cast("bigint").alias("empty_rows"),
        c(f"{f}_bad").alias("malformed_rows")) for f in fields]))
    return per_file.select(stack).groupBy("field").agg(
        *[F.sum(n).alias(n) for n in ("rows", "not_applicable_rows", "empty_rows", "malformed_rows")])


def offset_scan(staged: DataFrame, cfg: Config, offsets: range = range(-6, 7)) -> DataFrame:
    """L1 distance between the hour-of-day shares of the corrected files, shifted by each offset from their raw times, and those
    of the other files of the population. A shift by whole hours moves whole hours, so it is applied to the 24 hourly counts."""
    c = F.col
    files = [o.source_file for o in cfg.overrides]
    timed = staged.where(c("event_local").isNotNull() & (c("population") == cfg.primary))
    mine = c("source_file").isin(files)
    hours = timed.groupBy(
        mine.alias("corrected"),
        F.hour(F.when(mine, T.raw_wall(c("event_local"), c("tz_offset_hours"))).otherwise(c("event_local"))).alias("hour")).agg(F.count("*").alias("n"))
    share = c("n") / F.sum("n").over(Window.partitionBy("corrected"))
    shares = hours.withColumn("share", share)
    grid = F.explode(F.array(*[F.lit(o) for o in offsets]))
    moved = shares.where("corrected").select(grid.alias("offset_h"), c("hour"), c("share")).select(
        "offset_h", F.pmod(c("hour") + c("offset_h"), F.lit(24)).alias("hour"), c("share").alias("a"))
    reference = shares.where("not corrected").select(grid.alias("offset_h"), "hour", c("share").alias("b"))
    both = moved.join(reference, ["offset_h", "hour"], "full_outer").na.fill(0.0, ["a", "b"])
    return both.groupBy("offset_h").agg(F.sum(F.abs(c("a") - c("b"))).alias("l1_distance"))


def best_offset(scan: DataFrame) -> DataFrame:
    return scan.agg(F.min_by("offset_h", F.struct(F.round("l1_distance", 9), F.abs("offset_h"))).alias("best_offset"))


PROFILED = ("session_id", "event_time_raw", "weighing_type", "scale_id", "weight_raw", "component_raw", "tray_id", "ident_time_raw")


def column_profile(staged: DataFrame, cfg: Config, columns: tuple[str, ...] = PROFILED) -> DataFrame:
    """Tidy (scope, column, metric, value) for all rows and for each population: rows, empty, percent, distinct.

    Values are counted once per (column, value), with a count per population beside the total, so both scopes share one shuffle.
    """
    c = F.col
    scopes = {"all": F.lit(True), cfg.primary: c("population") == cfg.primary, cfg.other: c("population") == cfg.other}
    long = staged.select("population", F.inline(F.array(*[F.struct(F.lit(n).alias("column"), c(n).alias("v")) for n in columns])))
    values = long.groupBy("column", "v").agg(*[F.count_if(cond).alias(f"n{i}") for i, cond in enumerate(scopes.values())])
    blank = c("v").isNull() | (c("v") == "")
    per = values.groupBy("column").agg(*[x for i in range(len(scopes)) for x in (
        F.sum(f"n{i}").alias(f"rows{i}"), F.sum(F.when(blank, c(f"n{i}")).otherwise(0)).alias(f"empty{i}"),
        F.count_if((c(f"n{i}") > 0) & c("v").isNotNull()).alias(f"distinct{i}"))])
    rows = [F.struct(F.lit(s).alias("scope"), F.lit(m).alias("metric"), v.cast("double").alias("value"))
            for i, s in enumerate(scopes) for m, v in (
                ("rows", c(f"rows{i}")), ("null_or_empty", c(f"empty{i}")),
                ("null_pct", F.round(S.percent(c(f"empty{i}"), c(f"rows{i}")), 3)), ("distinct", c(f"distinct{i}")))]
    return per.select("column", F.inline(F.array(*rows)))


def quantile_profile(df: DataFrame, column: str, qs: tuple[float, ...], keys: list[str] | None = None) -> DataFrame:
    """n, mean, min, max and exact quantiles of an integer measure. Values are counted first: one row per distinct value."""
    c = F.col
    keys = keys or []
    counts = df.where(c(column).isNotNull()).groupBy(*keys, c(column).alias("v")).agg(F.count("*").alias("n"))
    quantiles = [S.exact_percentile(c("v"), q, c("n")).alias(f"p{q * 100:g}".replace(".", "_")) for q in qs]
    return counts.groupBy(*keys).agg(F.sum("n").alias("n_values"), (F.sum(c("v") * c("n")) / F.sum("n")).alias("mean"),
                                     F.min("v").alias("min"), F.max("v").alias("max"), *quantiles)


def weight_profile(staged: DataFrame) -> DataFrame:
    """Non-numeric weights, weights not above zero, and names with white space at an edge, for all rows and per population."""
    c = F.col
    # grouping sets ((population), ()): the total rides along with the groups
    per = staged.groupingSets([["population"], []], "population").agg(
        F.count("*").alias("rows"), F.count_if(c("weight_g").isNull()).alias("nonnumeric"), F.count_if(c("weight_g") <= 0).alias("not_positive"),
        F.count_if("has_edge_space").alias("edge_space"), F.min("event_local").alias("first_time"), F.max("event_local").alias("last_time"))
    return per.withColumn("scope", F.coalesce(c("population"), F.lit("all"))).drop("population")


def population_profile(sessions: DataFrame) -> DataFrame:
    """Session statistics per population, crossover sessions left out of both."""
    c = F.col
    w, span = c("weight_counted"), c("span_s")
    single = c("events_counted") == 1
    return sessions.where(~c("in_both_populations")).groupBy("population").agg(
        F.count("*").alias("sessions"), F.sum("events_counted").alias("events"), F.avg("events_counted").alias("events_mean"),
        S.exact_median(c("events_counted")).alias("events_median"), F.count_if(single).alias("single_event_sessions"),
        S.percent(F.count_if(single), F.count("*")).alias("single_event_pct"), S.percent(F.count_if("has_hot_scale"), F.count("*")).alias("hot_pct"),
        S.exact_percentile(w, 0.1).alias("weight_p10"), S.exact_median(w).alias("weight_median"), S.exact_percentile(w, 0.9).alias("weight_p90"),
        F.max(w).alias("weight_max"), S.percent(F.count_if(w < 50), F.count("*")).alias("under_50g_pct"),
        S.exact_median(c("n_components")).alias("components_median"), S.exact_median(span).alias("span_median"),
        S.exact_percentile(span, 0.99).alias("span_p99"), F.count_distinct(c("first_local").cast("date")).alias("service_days"),
        F.count_distinct("tray_single").alias("trays"))


def drift_by_file(flagged: DataFrame) -> DataFrame:
    """Per file: number of time shapes, first and last time as written, sessions, repeats, shape of the file name. The shapes
    themselves are rows of `time_shapes`."""
    c = F.col
    wall = T.raw_wall(c("event_local"), c("tz_offset_hours"))
    return flagged.groupBy("source_file").agg(
        F.count_distinct(X.digit_mask(c("event_time_raw"))).alias("event_shapes"), F.count_distinct(X.digit_mask(c("ident_time_raw"))).alias("ident_shapes"),
        T.iso_text(F.min(wall)).alias("first_event"), T.iso_text(F.max(wall)).alias("last_event"), F.count_distinct("session_id").alias("sessions"),
        F.count_if("is_repeat").alias("repeats")).withColumn("name_shape", X.digit_mask(c("source_file")))


def time_shapes(flagged: DataFrame) -> DataFrame:
    """(source_file, column, shape, n): how often each shape of a time text occurs in a file."""
    both = F.array(*[F.struct(F.lit(name).alias("column"), X.digit_mask(F.col(name)).alias("shape")) for name in ("event_time_raw", "ident_time_raw")])
    return flagged.select("source_file", F.inline(both)).groupBy("source_file", "column", "shape").agg(F.count("*").alias("n"))


def robust_day_z(days: DataFrame, cutoff: dt.date, cfg: Config) -> DataFrame:
    """Days from `cutoff` on against the weekday medians before it: ratio, and robust z of the ratio by median and MAD."""
    c = F.col
    mine = days.where(c("population") == cfg.primary).select("service_date", "weekday", "sessions")
    before = mine.where(c("service_date") < F.lit(cutoff))
    weekday = before.groupBy("weekday").agg(S.exact_median(c("sessions")).alias("weekday_median"))
    base = before.join(weekday, "weekday").select((c("sessions") / c("weekday_median")).alias("r"), F.lit(1).alias("one"))
    middle = base.groupBy("one").agg(S.exact_median(c("r")).alias("m"))
    spread = base.join(F.broadcast(middle), "one").groupBy("one", "m").agg(S.exact_median(F.abs(c("r") - c("m"))).alias("mad"))      # one row
    late = mine.where(c("service_date") >= F.lit(cutoff)).join(weekday, "weekday").withColumn("ratio", c("sessions") / c("weekday_median"))
    return (late.withColumn("one", F.lit(1)).join(F.broadcast(spread), "one")       # one row
            .select("service_date", "weekday", "sessions", "weekday_median", "ratio",
                    F.when(c("mad") > 0, (c("ratio") - c("m")) / (1.4826 * c("mad"))).alias("robust_z")))


def daily_composition(sessions: DataFrame, cfg: Config) -> DataFrame:
    """Per day of the primary population (crossover left out): events per session, shares, weights, trays, times, id range."""
    c = F.col
    number = X.id_number(c("session_id"))
    mine = sessions.where((c("population") == cfg.primary) & ~c("in_both_populations") & c("first_local").isNotNull())
    return mine.groupBy(c("first_local").cast("date").alias("day")).agg(
        F.count("*").alias("sessions"), F.avg("events_counted").alias("events_per_session"),
        S.percent(F.count_if(c("events_counted") == 1), F.count("*")).alias("single_event_pct"), S.percent(F.count_if("has_hot_scale"), F.count("*")).alias("hot_pct"),
        S.exact_median(c("weight_counted")).alias("median_weight"), S.exact_percentile(c("weight_counted"), 0.9).alias("p90_weight"),
        F.count_distinct("tray_single").alias("trays"), T.iso_text(F.min("first_local")).alias("first_time"), T.iso_text(F.max("first_local")).alias("last_time"),
        F.min(number).alias("id_min"), F.max(number).alias("id_max"))


def share_table(df: DataFrame, row: str, column: str) -> DataFrame:
    """Cross table normalised by column. The window runs over the counted cells, not the rows."""
    cells = df.groupBy(row, column).agg(F.count("*").alias("n"))
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(column)))


def average_ranks(df: DataFrame, column: str, out: str, most: int = MOST) -> DataFrame:
    """value -> mean rank of its ties. Equal values are counted first; the running total goes range by range, so no task sorts all."""
    c = F.col
    ranges = value_ranges(value_counts(df, column, []).withColumn("_all", F.lit(1)), ["_all"], most)
    upto = F.sum("n").over(Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranges.select(c("v").alias(column), (c("before") + upto - (c("n") - 1) / 2).alias(out))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation: Pearson correlation of the average ranks."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    ranked = pairs.join(average_ranks(pairs, a, "rank_a"), a).join(average_ranks(pairs, b, "rank_b"), b)
    return ranked.agg(F.corr("rank_a", "rank_b").alias("spearman"), F.count("*").alias("n"))


def name_variants(staged: DataFrame) -> DataFrame:
    """Normal forms with more than one trimmed spelling."""
    spelling = X.strip(F.col("component_raw"))
    forms = staged.where(F.col("component").isNotNull()).select("component", spelling.alias("spelling")).distinct()
    several = forms.groupBy("component").agg(F.count("*").alias("variants")).where("variants > 1")
    return forms.join(several, "component").select("component", "spelling", "variants")


def name_stability(staged: DataFrame, cfg: Config) -> DataFrame:
    """Names in all forms, names on several scales (twins apart and together), scale-days with several names."""
    c = F.col
    named = staged.where(c("component").isNotNull())
    per = named.groupBy("component").agg(F.count_distinct("scale_id").alias("scales"), F.count_distinct(X.collapse_twin(c("scale_id"), cfg.twin_sides)).alias("twins"))
    names = per.agg(F.count("*").alias("names"), F.count_if(c("scales") > 1).alias("on_several_scales"),
                    F.count_if(c("twins") > 1).alias("on_several_twins")).withColumn("one", F.lit(1))
    cells = (named.where(c("event_local").isNotNull())
             .groupBy("scale_id", c("event_local").cast("date").alias("day"), "population").agg(F.count_distinct("component").alias("n")))
    multi = cells.agg(F.count("*").alias("cells"), F.count_if(c("n") > 1).alias("cells_with_several")).withColumn("one", F.lit(1))
    return names.join(F.broadcast(multi), "one").drop("one")        # one row


def definition_contrast(sessions: DataFrame, cfg: Config) -> DataFrame:
    """The component count under four definitions: median, mean, sessions that differ from the chosen one, and their percentage."""
    c = F.col
    mine = sessions.where((c("population") == cfg.primary) & ~c("in_both_populations"))
    definitions = {"normalised_names": "n_components", "raw_names": "n_raw_components", "scales": "n_scales", "events": "events_counted"}
    one = mine.agg(F.count("*").alias("n"), *[x for d, col in definitions.items() for x in (
        S.exact_median(c(col)).alias(f"{d}_median"), F.avg(col).alias(f"{d}_mean"), F.count_if(c(col) != c("n_components")).alias(f"{d}_differ"))])
    return one.select(F.inline(F.array(*[F.struct(
        F.lit(d).alias("definition"), c(f"{d}_median").alias("median"), F.round(f"{d}_mean", 3).alias("mean"), c(f"{d}_differ").alias("sessions_differing"),
        F.round(S.percent(c(f"{d}_differ"), c("n")), 2).alias("pct_differing")) for d in definitions])))


def daily_by_population(sessions: DataFrame, cfg: Config) -> DataFrame:
    """Sessions per day with a column per population, and the weekday."""
    c = F.col
    day = c("first_local").cast("date")
    return (sessions.where(~c("in_both_populations") & c("first_local").isNotNull()).groupBy(day.alias("service_date"))
            .pivot("population", [cfg.primary, cfg.other]).agg(F.count(F.lit(1)))
            .na.fill(0, [cfg.primary, cfg.other]).withColumn("weekday", T.weekday_name(c("service_date"))))


def disjoint_share_by_day(agreement: DataFrame) -> DataFrame:
    return agreement.groupBy("day").agg(F.avg(F.col("disjoint").cast("double")).alias("disjoint_share"), F.count("*").alias("cells"))


def id_range_by_file(sessions_by_file: DataFrame) -> DataFrame:
    number = X.id_number(F.col("session_id"))
    return sessions_by_file.groupBy("population", "source_file").agg(
        F.min(number).alias("id_min"), F.max(number).alias("id_max"), F.count_distinct("session_id").alias("sessions"))


def context_null_hours(context: DataFrame, parameters: tuple[str, ...]) -> DataFrame:
    """Hours whose value is missing, per parameter."""
    one = context.agg(*[F.count_if(F.col(f"{p}_value").isNull()).alias(p) for p in parameters], F.count("*").alias("hours"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(p).alias("parameter"), F.col(p).alias("null_hours"), F.col("hours")) for p in parameters])))


def hour_join_comparison(facts: DataFrame, context: DataFrame, parameter: str, cfg: Config) -> DataFrame:
    """Floor hour against ceiled hour: sessions matched, and sessions without the value, for each."""
    c = F.col
    live = facts.where((c("population") == cfg.primary) & ~c("is_quarantined") & c("first_weighing_utc").isNotNull())
    both = live.select(F.inline(F.array(
        F.struct(F.lit("floor").alias("basis"), T.floor_hour(c("first_weighing_utc")).alias("hour")),
        F.struct(F.lit("ceil").alias("basis"), T.ceil_hour(c("first_weighing_utc")).alias("hour")))))
    side = context.select(c("obs_utc").alias("hour"), F.lit(True).alias("found"), c(f"{parameter}_value").alias("v"))
    return both.join(side, "hour", "left").groupBy("basis").agg(
        F.count("*").alias("sessions"), F.count("found").alias("matched"), F.count_if(c("v").isNull()).alias("without_value"))


# ---- sequences ----------------------------------------------------------------------------------------------------------------------
def with_gaps(flagged: DataFrame, most: int = MOST) -> DataFrame:
    """Per counted event: gap to the previous event of its session, and gap, weight and name of the previous one on the same scale.

    The events of a session of more than `most` are cut into ranges of time, one instant with many of them into runs of rows; a range's
    first event takes the last one of the range before. A session of any size is therefore ordered by several tasks.
    """
    c = F.col
    rows = flagged.where(~c("is_repeat") & c("event_local").isNotNull())
    order = ["event_local", "source_file", "source_row_number"]
    blocked = range_blocks(rows, ["session_key"], "event_local", most, (c("source_file"), F.floor(c("source_row_number") / most)))
    in_session = lagged(blocked, ["session_key"], order, {"previous_local": "event_local"})
    on_scale = lagged(in_session, ["session_key", "scale_id"], order, {"scale_previous_local": "event_local", "previous_weight": "weight_g", "previous_name": "component"})
    return on_scale.select(
        "event_id", "session_key", "population", "scale_id", "component", "weight_g", "event_local",
        T.seconds_between(c("previous_local"), c("event_local")).alias("gap_s"),
        T.seconds_between(c("scale_previous_local"), c("event_local")).alias("scale_gap_s"), "previous_weight",
        F.when(c("scale_previous_local").isNotNull(), c("component").eqNullSafe(c("previous_name"))).alias("same_name_as_previous"))


def repeat_share(flagged: DataFrame) -> DataFrame:
    """Per session that used a scale again: the share of its weight carried by the second and later events on a scale.

    The first event of a (session, scale) is found by aggregate, so later events are everything but that one.
    """
    c = F.col
    counted = flagged.where(~c("is_repeat"))
    key = F.struct(c("event_local"), c("source_file"), c("source_row_number"))
    per_scale = counted.groupBy("session_key", "scale_id").agg(
        F.count("*").alias("n"), F.sum("weight_g").alias("w"), F.coalesce(F.min_by(c("weight_g"), key), F.lit(0)).alias("first_w"))
    per_session = per_scale.groupBy("session_key").agg(
        F.sum("w").alias("total"), F.sum(F.when(c("n") > 1, F.coalesce(c("w"), F.lit(0)) - c("first_w"))).alias("repeat_weight"))
    return per_session.where("repeat_weight is not null and total > 0").select(
        "session_key", "total", "repeat_weight", (F.lit(100.0) * c("repeat_weight") / c("total")).alias("repeat_pct"))


def repeat_share_summary(shares: DataFrame) -> DataFrame:
    """Median and P90 of the share: many distinct doubles in one group, so from ranks."""
    c = F.col
    p = ranked_percentiles(shares, "repeat_pct", [0.5, 0.9])
    return p.agg(F.max(F.when(c("q") == 0.5, c("value"))).alias("median_pct"), F.max(F.when(c("q") == 0.9, c("value"))).alias("p90_pct"))


def percent_position(df: DataFrame, column: str, value: Column) -> Column:
    """Share of values below `value`, as an aggregate column."""
    return S.percent(F.count_if(F.col(column) < value), F.count(column))


def largest_event_context(flagged: DataFrame, facts: DataFrame, cfg: Config) -> DataFrame:
    """Where the largest event stands: among the events of its scale, of its name, and its session among core sessions."""
    from measurekit.operators.scenarios import largest_event

    c = F.col
    top = largest_event(flagged).select(F.lit(1).alias("one"), c("event_id").alias("top_event"), c("session_key").alias("top_key"), c("weight_g").alias("top_weight"))
    where = flagged.select("event_id", "scale_id", "component").join(
        F.broadcast(top.select(c("top_event").alias("event_id"), "one", "top_key", "top_weight")), "event_id")      # one row
    place = where.select("one", c("scale_id").alias("top_scale"), c("component").alias("top_component"), c("event_id").alias("top_event"), "top_key", "top_weight")
    ev = flagged.where(c("weight_g").isNotNull()).withColumn("one", F.lit(1)).join(F.broadcast(place), "one")       # one row
    same_scale, same_name = c("scale_id") == c("top_scale"), c("component").eqNullSafe(c("top_component"))

    def below(cond: Column) -> Column:
        return F.round(S.percent(F.count_if(cond & (c("weight_g") < c("top_weight"))), F.count_if(cond)), 6)

    return ev.groupBy("top_event", "top_key", "top_weight").agg(
        F.count_if(same_scale).alias("scale_events"), below(same_scale).alias("scale_percent_below"),
        F.count_if(same_name).alias("name_events"), below(same_name).alias("name_percent_below"))


def events_at_least(flagged: DataFrame, facts: DataFrame, grams: int) -> DataFrame:
    """Events of at least `grams`, heaviest first, with the weight of their session."""
    heavy = flagged.where(F.col("weight_g") >= grams).select("event_id", "session_key", "scale_id", "component", "weight_g")
    return heavy.join(facts.select("session_key", "selected_weight_g", "core_ready"), "session_key", "left").orderBy(F.desc("weight_g"), "event_id")


def longest_sessions(sessions: DataFrame, n: int) -> DataFrame:
    return sessions.where("span_s is not null").orderBy(F.desc("span_s"), "session_key").select("session_key", "population", "events_counted", "weight_counted", "span_s").limit(n)


def disagreement_examples(agreement: DataFrame, n: int) -> DataFrame:
    return agreement.where("disjoint").orderBy("scale_id", "day").select("scale_id", "day", "names").limit(n)


def top_scales_by_flag_rate(portions: DataFrame, n: int = 5) -> DataFrame:
    return portions.orderBy(F.desc("heavy_rate_pct"), "scale_id").limit(n)


def single_event_sessions(flagged: DataFrame, sessions: DataFrame, cfg: Config) -> DataFrame:
    """Primary single-event sessions (crossover left out) with their one event and the weekday."""
    c = F.col
    ones = sessions.where((c("population") == cfg.primary) & ~c("in_both_populations") & (c("events_counted") == 1)).select("session_key", "ident_minus_last_s", "first_local")
    events = flagged.where(~c("is_repeat")).select("session_key", "scale_id", "component_raw", "weight_g")
    return ones.join(events, "session_key").select("session_key", T.weekday_name(c("first_local").cast("date")).alias("weekday"),
                                                   "scale_id", "component_raw", "weight_g", "ident_minus_last_s")


def single_event_summary(ones: DataFrame, cfg: Config) -> DataFrame:
    c = F.col
    return ones.agg(F.count("*").alias("sessions"), F.count_if(c("scale_id").contains(cfg.hot_kind)).alias("hot"), S.exact_median(c("weight_g")).alias("median_weight"),
                    F.count_if(c("weight_g") <= 3).alias("le_3g"), F.count_if(c("weight_g") <= 50).alias("le_50g"))
