"""Session findings, and the comparison of both populations' versions and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from measurekit.config import Config
from measurekit.operators.ranges import MOST, range_blocks
from measurekit.operators.rules_events import finding, inline_findings


def session_findings(sessions: DataFrame, cfg: Config) -> DataFrame:
    """I01, I04, T06, B04, B07, T05, T04 and B05 in one scan of the session rows."""
    c = F.col
    low, high = cfg.session_weight

    def one(rule: str, observed: Column, expected: str, description: str) -> Column:
        return finding(rule, c(f"hit_{rule}"), "session", c("session_key"), observed, expected, description, "SESSION_EVENT_ROWS",
                       session_key=c("session_key"), population=c("population"), source_file=c("source_files"))

    grams = F.concat(c("weight_counted").cast("string"), F.lit(" g"))
    return inline_findings(sessions, [
        one("I01", c("session_id"), "a session id belongs to one population", "the session id exists in both populations"),
        one("I04", c("tray_count"), "exactly one tray", "the session key has more than one tray"),
        one("T06", c("ident_values"), "ident_values = 1", "the rows of the session carry different identification times"),
        one("B04", F.concat_ws(" event; ", c("events_counted").cast("string"), F.coalesce(grams, F.lit("no weight"))),
            "more than one event", "a single weighing event"),
        one("B07", grams, f"{low:g} <= weight <= {high:g} g", "session weight outside the range"),
        one("T05", F.concat(c("span_s").cast("string"), F.lit(" s")), f"not {cfg.session_span.operator} {cfg.session_span.value:g} s",
            "long session"),
        one("T04", F.concat(c("ident_minus_last_s").cast("string"), F.lit(" s")), "identification not before the last weighing",
            "identified before the last weighing"),
        one("B05", c("repeated_scales"), "usually once per scale", "one scale was used repeatedly; further scoops add up"),
    ])


def version_findings(versions: DataFrame) -> DataFrame:
    """How the two versions of a crossover session differ; identical versions are only a note."""
    c = F.col
    observed = F.format_string("events %d vs %d; same scales and weights %s; name conflicts %d",
                               c("events_a"), c("events_b"), c("same_multiset").cast("string"), c("name_conflicts"))
    return inline_findings(versions, [finding(
        "I06", F.lit(True), "session_id", c("session_id"), observed, "both populations hold the same events", "the session's events in one population held against the other",
        "EVENT_ROW_SET", population=F.lit("both"), severity=F.when(c("identical"), "INFO"))])


def name_findings(agreement: DataFrame) -> DataFrame:
    """A scale-day seen in both populations without a shared name."""
    c = F.col
    return inline_findings(agreement, [finding(
        "I07", c("disjoint"), "scale_day", F.concat_ws("|", "scale_id", c("day").cast("string")),
        F.concat(c("names").cast("string"), F.lit(" names, none shared")), "overlapping names",
        "the populations share no component name on this scale and day", "EVENT_ROW_SET", population=F.lit("both"))])


def tray_overlaps(sessions: DataFrame, most: int = MOST) -> DataFrame:
    """Per tray, its sessions and how many pairs of them overlap in time [first, last].

    Pairs are counted, not listed: two sessions do not overlap exactly when one ends before the other starts, so it is enough to
    count, for each start, the ends before it. Starts and ends are summed by instant, the instants of a busy tray are cut into ranges of
    time, and the ends of the ranges before are carried over, so a tray in constant use spreads over several tasks.
    """
    c = F.col
    used = sessions.where(c("tray_single").isNotNull() & c("first_utc").isNotNull())
    points = used.select(c("tray_single").alias("tray_id"), F.inline(F.array(
        F.struct(c("first_utc").alias("t"), F.lit(0).alias("is_end")), F.struct(c("last_utc").alias("t"), F.lit(1).alias("is_end")))))
    instants = points.groupBy("tray_id", "t").agg(F.sum("is_end").alias("ends"), F.count_if(c("is_end") == 0).alias("starts"))
    blocked = range_blocks(instants, ["tray_id"], "t", most)
    # an end at the very moment of a start is not before it
    earlier = Window.partitionBy("tray_id", "block").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    per_block = (blocked.withColumn("ended", F.coalesce(F.sum("ends").over(earlier), F.lit(0))).groupBy("tray_id", "block")
                 .agg(F.sum("ends").alias("ends"), F.sum("starts").alias("starts"), F.sum(c("starts") * c("ended")).alias("ended_in_block")))
    before = Window.partitionBy("tray_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per_block = per_block.withColumn("ended_before", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    n = F.sum("starts")
    apart = F.sum(c("ended_in_block") + c("starts") * c("ended_before"))
    return per_block.groupBy("tray_id").agg(n.alias("sessions"), (F.floor(n * (n - 1) / 2).cast("bigint") - apart).alias("overlapping_pairs"))


def neighbour_day_names(staged: DataFrame, agreement: DataFrame, cfg: Config, reach: int = 4) -> DataFrame:
    """For disjoint scale-days: on how many of them do the primary names appear in the other population's names of the same
    scale, 1 to `reach` days earlier or later. The day offset is exploded, so the join is on equality only."""
    c = F.col
    named = (staged.where(c("event_local").isNotNull() & c("component").isNotNull())
             .select("population", "scale_id", c("event_local").cast("date").alias("day"), "component").distinct())
    offsets = F.array(*[F.lit(k) for k in range(-reach, reach + 1) if k])
    mine = (named.where(c("population") == cfg.primary)
            .join(agreement.where("disjoint").select("scale_id", "day"), ["scale_id", "day"], "left_semi")
            .select("scale_id", "day", "component", F.explode(offsets).alias("offset_days"))
            .withColumn("other_day", F.date_add("day", c("offset_days"))))
    theirs = named.where(c("population") == cfg.other).select("scale_id", c("day").alias("other_day"), "component")
    return (mine.join(theirs, ["scale_id", "other_day", "component"], "left_semi")
            .select("scale_id", "day", "offset_days").distinct()
            .groupBy("offset_days").agg(F.count("*").alias("scale_days")))


def agreement_summary(agreement: DataFrame, staged: DataFrame, cfg: Config) -> DataFrame:
    """Agreement of names by period: days covered by a corrected file, and the others."""
    c = F.col
    files = [o.source_file for o in cfg.overrides]
    days = staged.where(c("source_file").isin(files)).select(c("event_local").cast("date").alias("day")).distinct()
    joined = agreement.join(days.withColumn("hit", F.lit(True)), "day", "left")
    return (joined.groupBy(F.coalesce(c("hit"), F.lit(False)).alias("in_corrected_file"))
            .agg(F.count("*").alias("cells"), F.avg(c("identical").cast("double")).alias("identical_share"),
                 F.avg("jaccard").alias("jaccard"), F.avg(c("disjoint").cast("double")).alias("disjoint_share")))
