"""Session profiles: one row per session key, everything about a session from a single aggregate over the flagged events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from measurekit.config import EVENT_WARN_RULES, SESSION_WARN_RULES, Config
from measurekit.functions import stats as S
from measurekit.functions import times as T
from measurekit.operators.rules_events import EVENT_RULES

SESSION_RULES = ("I01", "I04", "T06", "B04", "B07", "T05", "T04")


def _shifted_out(offset: int, cfg: Config) -> Column:
    """A non-repeat event of a corrected file whose raw time plus `offset` hours leaves service hours."""
    files = [o.source_file for o in cfg.overrides]
    moved = T.raw_wall(F.col("event_local"), F.col("tz_offset_hours")) + T.hours(offset)
    return F.coalesce(F.col("source_file").isin(files) & ~S.inside_half_open(F.hour(moved), *cfg.service_hours), F.lit(False))


DISTINCT = {"ident_values": "ident_utc", "tray_count": "tray_id", "n_components": "component", "n_raw_components": "component_raw", "n_scales": "scale_id"}


def distinct_counts(flagged: DataFrame) -> DataFrame:
    """Per session key: distinct values of several columns, among counted rows (trays: among all rows, empty text left out).

    The columns are stacked as (session, column, value) and made distinct in one narrow shuffle, which splits a session holding a
    large share of all rows by its values. Several `count_distinct` beside the wide aggregate would instead copy every wide row
    once per column.
    """
    c = F.col
    counted = ~c("is_repeat")

    def value(name: str) -> Column:
        if name == "tray_id":
            return F.nullif(c(name), F.lit(""))
        return F.when(counted, c(name).cast("string"))

    stacked = flagged.select("session_key", F.inline(F.array(*[
        F.struct(F.lit(out).alias("which"), value(name).alias("value")) for out, name in DISTINCT.items()])))
    values = stacked.where(c("value").isNotNull()).groupBy("session_key", "which", "value").agg(F.lit(1).alias("seen"))
    return values.groupBy("session_key").agg(*[F.count_if(c("which") == out).alias(out) for out in DISTINCT])


def session_profiles(flagged: DataFrame, cfg: Config) -> DataFrame:
    """One row per session key. Timing, identity and weight use rows that are not repeats ("counted"); `*_all` uses every row.

    Everything that needs no distinct values comes from one aggregate, whose partial results combine before the shuffle; unused
    aggregates are pruned by Catalyst. The distinct counts join it on the same key, without another shuffle.
    """
    counted = ~F.col("is_repeat")
    c = F.col

    def kept(name: str) -> Column:
        return F.when(counted, c(name))

    order = [c("event_utc"), c("source_file"), c("source_row_number")]
    late_order = [c("event_utc"), c("source_file"), -c("source_row_number")]
    timed = counted & c("event_utc").isNotNull()

    def extreme(pick, name: str, key: list[Column]) -> Column:
        return pick(c(name), F.when(timed, F.struct(*key)))

    ident = kept("ident_utc")
    in_override = counted & c("source_file").isin([o.source_file for o in cfg.overrides])
    wall = T.raw_wall(c("event_local"), c("tz_offset_hours"))
    aggregates = {
        "session_id": F.min("session_id"),
        "population": F.min("population"),
        "source_snapshot_id": F.min("source_snapshot_id"),
        "events_staged": F.count("*"),
        "events_counted": F.count_if(counted),
        "repeats": F.count_if(c("is_repeat")),
        "source_files": S.joined_set(c("source_file")),
        "first_counted_local": F.min(kept("event_local")),
        "first_local": extreme(F.min_by, "event_local", order),
        "first_utc": F.min(kept("event_utc")),
        "last_local": extreme(F.max_by, "event_local", late_order),
        "last_utc": F.max(kept("event_utc")),
        "min_ident_utc": F.min(ident),
        "max_ident_utc": F.max(ident),
        "ident_single_local": S.single_value(c("ident_local"), text=False),
        "ident_single_utc": S.single_value(c("ident_utc"), text=False),
        "min_tray": F.min(F.nullif(c("tray_id"), F.lit(""))),
        "max_tray": F.max(F.nullif(c("tray_id"), F.lit(""))),
        "weight_counted": S.strict_sum(c("weight_g"), counted),
        "weight_all": S.strict_sum(c("weight_g")),
        "has_hot_scale": F.bool_or(F.coalesce(c("scale_kind") == cfg.hot_kind, F.lit(False))),
        "override_events": F.count_if(in_override & c("event_local").isNotNull()),
        "override_first_wall": F.min(F.when(in_override, wall)),
        **{f"any_{rule}": F.bool_or(f"hit_{rule}") for rule in EVENT_RULES},
        **{f"tz_out_{h}": F.bool_or(counted & _shifted_out(h, cfg)) for h in range(5)},
    }
    wide = flagged.groupBy("session_key").agg(*[agg.alias(name) for name, agg in aggregates.items()])
    return (wide.join(distinct_counts(flagged), "session_key", "left").na.fill(0, list(DISTINCT))
            .withColumn("tray_single", F.when(c("min_tray") == c("max_tray"), c("max_tray"))))


def flag_sessions(profiles: DataFrame, cfg: Config) -> DataFrame:
    """Session rules as `hit_<rule>` columns, the span, and whether the session is quarantined.

    The window sees at most one row per population for an id, so its groups stay tiny.
    """
    c = F.col
    span = T.seconds_between(c("first_utc"), c("last_utc"))
    gap = T.seconds_between(c("last_utc"), c("min_ident_utc"))
    both = F.count("*").over(Window.partitionBy("session_id")) > 1
    timed = profiles.withColumns({"span_s": span, "ident_minus_last_s": gap, "in_both_populations": both})
    low, high = cfg.session_weight
    flags = {
        "I01": c("in_both_populations"),
        "I04": c("min_tray") != c("max_tray"),
        "T06": c("min_ident_utc") != c("max_ident_utc"),
        "B04": (c("population") == cfg.primary) & (c("events_counted") == 1),
        "B07": S.outside_closed(c("weight_counted"), low, high),
        "T05": S.compare(c("span_s"), cfg.session_span),
        "T04": c("ident_minus_last_s") < 0,
    }
    flagged = timed.withColumns({f"hit_{rule}": F.coalesce(cond, F.lit(False)) for rule, cond in flags.items()})
    return flagged.withColumn("is_quarantined", quarantine_flag(cfg))


def quarantine_flag(cfg: Config) -> Column:
    """True where any rule whose handling is QUARANTINE fired on the session or on one of its events."""
    out = F.lit(False)
    for rule in cfg.rules_with(handling="QUARANTINE"):
        if rule in EVENT_RULES:
            out = out | F.col(f"any_{rule}")
        elif rule in ("I01", "I04", "T06"):
            out = out | F.col(f"hit_{rule}")
    return out


def crossover_ids(profiles: DataFrame) -> DataFrame:
    """Session ids present in more than one population."""
    return (profiles.groupBy("session_id").agg(F.count_distinct("population").alias("populations"))
            .where("populations > 1").select("session_id"))


def repeated_scales(flagged: DataFrame) -> DataFrame:
    """Sessions that used one scale more than once (repeats left out), with the scales. Counts first, so only scales are listed."""
    return (flagged.where(~F.col("is_repeat")).groupBy("session_key", "scale_id").agg(F.count("*").alias("n"))
            .where("n > 1")
            .groupBy("session_key")
            .agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col("scale_id"), F.lit(" x"), F.col("n").cast("string")))), ";")
                 .alias("repeated_scales")))


def version_pairs(flagged: DataFrame, sessions: DataFrame, cfg: Config) -> DataFrame:
    """Pair the events of both versions of a crossover session by (scale, weight) and time rank.

    Ranking inside (session, population, scale, weight) pairs the same rows as ranking a whole session sorted by scale, weight
    and time whenever the two versions hold the same scales and weights, and keeps the sorted groups small.
    """
    crossing = sessions.where("in_both_populations").select("session_key")
    weight = F.coalesce(F.col("weight_g"), F.lit(-1))
    rank = Window.partitionBy("session_id", "population", "scale_id", "pair_weight").orderBy(
        F.col("event_utc").asc_nulls_first(), "source_file", "source_row_number")
    rows = (flagged.where(~F.col("is_repeat")).join(crossing, "session_key", "left_semi")
            .select("session_id", "population", "scale_id", weight.alias("pair_weight"), "component", "event_utc", "event_local",
                    "tz_offset_hours", "source_file", "source_row_number")
            .withColumn("pair_rank", F.row_number().over(rank)))
    first, second = sorted((cfg.primary, cfg.other))

    def side(population: str) -> Column:
        """The one row of a population in a pair, NULL where it has none."""
        return F.max(F.when(F.col("population") == population, F.struct(
            F.coalesce("component", F.lit("")).alias("name"), F.col("event_utc").alias("utc"),
            T.raw_wall(F.col("event_local"), F.col("tz_offset_hours")).alias("wall"))))

    # both versions of a pair meet in one group of at most two rows
    return rows.groupBy("session_id", "scale_id", "pair_weight", "pair_rank").agg(side(first).alias("a"), side(second).alias("b"))


def compare_versions(pairs: DataFrame) -> DataFrame:
    """Per crossover id: event counts, same (scale, weight) multiset, time differences, name conflicts, identical or not."""
    c = F.col
    matched = c("a").isNotNull() & c("b").isNotNull()
    delta, wall_delta = T.seconds_between(c("a.utc"), c("b.utc")), T.seconds_between(c("a.wall"), c("b.wall"))
    grouped = pairs.groupBy("session_id").agg(
        F.count("a").alias("events_a"), F.count("b").alias("events_b"),
        (F.count_if(~matched) == 0).alias("same_multiset"),
        F.min(delta).alias("lo"), F.max(delta).alias("hi"), F.min(wall_delta).alias("wall_lo"), F.max(wall_delta).alias("wall_hi"),
        F.count_if(matched & (c("a.name") != c("b.name"))).alias("conflicts"))

    def same(x: Column) -> Column:
        return F.when(c("same_multiset"), x)

    return grouped.select(
        "session_id", "events_a", "events_b", "same_multiset",
        same(c("lo")).alias("min_delta_s"), same(c("hi")).alias("max_delta_s"),
        same(c("wall_lo")).alias("min_wall_delta_s"), same(c("wall_hi")).alias("max_wall_delta_s"),
        F.when(c("same_multiset"), c("conflicts")).otherwise(0).alias("name_conflicts"),
        (c("same_multiset") & (F.coalesce(c("lo"), F.lit(0)) == 0) & (F.coalesce(c("hi"), F.lit(0)) == 0) & (c("conflicts") == 0))
        .alias("identical"))


def with_session_rules(sessions: DataFrame, repeated: DataFrame, versions: DataFrame, cfg: Config) -> DataFrame:
    """Adds B05 and I06 (which need their own groupings) and the rule ids of a session by severity."""
    joined = (sessions.join(repeated, "session_key", "left")
              .join(versions.select("session_id", "identical"), "session_id", "left")
              .withColumn("hit_B05", F.col("repeated_scales").isNotNull() & ~F.col("is_quarantined"))
              .withColumn("hit_I06", F.col("identical").isNotNull()))
    return with_rule_ids(joined, cfg)


def with_day_flags(sessions: DataFrame, days: DataFrame) -> DataFrame:
    """Adds `low_volume_day` and `volume_irregularity` of the session's own population on the day of its first event."""
    flags = days.select("population", "service_date", "low_volume_day", "volume_irregularity")
    joined = sessions.withColumn("service_date", F.col("first_local").cast("date")).join(flags, ["population", "service_date"], "left")
    return joined.na.fill(False, ["low_volume_day", "volume_irregularity"])


def with_rule_ids(sessions: DataFrame, cfg: Config) -> DataFrame:
    """error / warn / info rule ids as sorted `;` lists, plus the two WARN flags the metrics use."""
    hits = {**{r: F.col(f"any_{r}") for r in EVENT_RULES}, **{r: F.col(f"hit_{r}") for r in (*SESSION_RULES, "B05", "I06")}}

    def severity_of(rule: str) -> Column:
        base = F.lit(cfg.catalogue[rule].severity)
        return F.when(F.col("identical"), F.lit("INFO")).otherwise(base) if rule == "I06" else base

    def fired(rule: str, severity: str) -> Column:
        return hits[rule] & (severity_of(rule) == severity)

    def ids(severity: str) -> Column:
        return F.array_join(F.array_compact(F.array(*[F.when(fired(r, severity), F.lit(r)) for r in sorted(hits)])), ";")

    def any_warn(rules: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for r in rules:
            out = out | F.coalesce(fired(r, "WARN"), F.lit(False))
        return out

    return sessions.withColumns({
        "error_rule_ids": ids("ERROR"), "warn_rule_ids": ids("WARN"), "info_rule_ids": ids("INFO"),
        "has_session_warn": any_warn(SESSION_WARN_RULES), "has_event_warn": any_warn(EVENT_WARN_RULES),
    }).withColumn("quarantine_rule_ids", F.when(F.col("is_quarantined"), F.col("error_rule_ids")).otherwise(""))
