"""Findings of all rules in one shape: catalogue data added, ordered, checked, counted, and traced back to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measurekit.config import CONTEXT_RULES, EVENT_WARN_RULES, SESSION_WARN_RULES, Config
from measurekit.functions import text as X


def catalogue_table(spark: SparkSession, cfg: Config) -> DataFrame:
    rows = [(i, r.rule_id, r.category, r.severity, r.handling) for i, r in enumerate(cfg.catalogue.values())]
    return spark.createDataFrame(rows, "rule_order int, rule_id string, category string, severity string, handling string")


def concat_findings(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def finalise(findings: DataFrame, cfg: Config) -> DataFrame:
    """Add id, category, severity and handling. The catalogue holds a few dozen rows, so it is broadcast; a finding
    of a rule it does not know stops the job."""
    cat = F.broadcast(catalogue_table(findings.sparkSession, cfg))
    joined = findings.join(cat, "rule_id", "left")
    known = F.when(F.col("category").isNull(), F.raise_error(F.concat(F.lit("finding of an unknown rule: "), F.col("rule_id"))))
    return joined.select(
        X.finding_id(F.col("rule_id"), F.col("entity_type"), F.col("entity_id")).alias("finding_id"), "rule_id", "rule_order",
        known.otherwise(F.col("category")).alias("category"), F.coalesce("severity_override", "severity").alias("severity"), "handling",
        (F.col("handling") == "QUARANTINE").alias("quarantine"), "entity_type", "entity_id", "session_key", "event_id", "population",
        "source_file", "lineage_basis", "observed_value", "expected_condition", "description")


def in_catalogue_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy("rule_order", "population", "entity_id", "event_id")


def duplicate_ids(findings: DataFrame) -> DataFrame:
    """Finding ids that name more than one finding; must be empty."""
    return findings.groupBy("finding_id").agg(F.count("*").alias("n")).where("n > 1")


def unknown_rules(findings: DataFrame, cfg: Config) -> DataFrame:
    return findings.join(F.broadcast(catalogue_table(findings.sparkSession, cfg)), "rule_id", "left_anti").select("rule_id").distinct()


def refuse_bad(findings: DataFrame, cfg: Config) -> DataFrame:
    """Stop where a rule is unknown or an id is not unique. Looks at one offending row at most."""
    bad = unknown_rules(findings, cfg).limit(1).collect()
    if bad:
        raise ValueError(f"finding of an unknown rule: {bad[0]['rule_id']}")
    final = finalise(findings, cfg)
    twice = duplicate_ids(final).limit(1).collect()
    if twice:
        raise ValueError(f"finding id is not unique: {twice[0]['finding_id']}")
    return final


def quarantine_keys(final: DataFrame) -> DataFrame:
    """Session keys named by a finding whose handling is QUARANTINE."""
    return final.where(F.col("quarantine") & (F.col("session_key") != "")).select("session_key").distinct()


def findings_by_session(final: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_key, severity, rule): findings with a key, and session-id findings fanned out to both keys of the id."""
    keyed = final.where("session_key <> ''").select("session_key", "severity", "rule_id")
    by_id = (final.where("entity_type = 'session_id'").select(F.col("entity_id").alias("session_id"), "severity", "rule_id")
             .join(sessions.select("session_id", "session_key"), "session_id").select("session_key", "severity", "rule_id"))
    return keyed.unionByName(by_id).distinct()


def session_rule_ids(by_session: DataFrame) -> DataFrame:
    """Rule ids per severity and the two WARN flags, from findings alone. The lists are bounded by the catalogue."""
    c = F.col

    def ids(severity: str):
        return F.array_join(F.array_sort(F.collect_set(F.when(c("severity") == severity, c("rule_id")))), ";").alias(f"{severity.lower()}_rule_ids")

    warn = c("severity") == "WARN"
    return by_session.groupBy("session_key").agg(
        ids("ERROR"), ids("WARN"), ids("INFO"),
        F.bool_or(warn & c("rule_id").isin(*SESSION_WARN_RULES)).alias("has_session_warn"),
        F.bool_or(warn & c("rule_id").isin(*EVENT_WARN_RULES)).alias("has_event_warn"))


def event_rule_ids(final: DataFrame) -> DataFrame:
    """Per event: rule ids by severity."""
    c = F.col

    def ids(severity: str):
        return F.array_join(F.array_sort(F.collect_set(F.when(c("severity") == severity, c("rule_id")))), ";").alias(f"{severity.lower()}_rule_ids")

    return final.where("event_id <> ''").groupBy("event_id").agg(ids("ERROR"), ids("WARN"), ids("INFO"))


def by_rule(final: DataFrame) -> DataFrame:
    return (final.groupBy("rule_id", "category", "severity", F.when(F.col("population") == "", "n/a").otherwise(F.col("population")).alias("population"))
            .agg(F.count("*").alias("issues"), F.count_distinct("entity_id").alias("entities"), F.bool_or("quarantine").alias("quarantine")))


def quarantine_manifest(final: DataFrame, disposed: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row per quarantined key and one per event of it, each with the rules that quarantined the key."""
    reasons = (final.where(F.col("quarantine") & (F.col("session_key") != "")).groupBy("session_key")
               .agg(F.array_join(F.array_sort(F.collect_set("rule_id")), ";").alias("quarantine_rule_ids")))
    keys = sessions.join(reasons, "session_key").select(
        F.lit("session_key").alias("entity_type"), F.col("session_key").alias("entity_id"), "session_key", "population",
        F.col("source_files").alias("source_file"), "quarantine_rule_ids")
    events = disposed.join(reasons, "session_key").select(
        F.lit("event").alias("entity_type"), F.col("event_id").alias("entity_id"), "session_key", "population", "source_file", "quarantine_rule_ids")
    return keys.unionByName(events)


def lineage(final: DataFrame, events: DataFrame) -> DataFrame:
    """(finding, event) rows behind findings on events and on sessions: a relation, so a session of any size stays spread out."""
    direct = final.where("lineage_basis in ('EVENT_ROW', 'EVENT_ROW_SET') and event_id <> ''").select("finding_id", "event_id")
    whole = (final.where("lineage_basis = 'SESSION_EVENT_ROWS'").select("finding_id", "session_key")
             .join(events.select("session_key", "event_id"), "session_key").select("finding_id", "event_id"))
    return direct.unionByName(whole)


def rows_of_event_findings(final: DataFrame, events: DataFrame) -> DataFrame:
    """Findings on events, mapped back to sessions by the `file#row` in their entity id."""
    parsed = final.where("entity_type = 'event'").select(
        "finding_id", "rule_id", F.split_part("entity_id", F.lit("#"), F.lit(1)).alias("source_file"),
        F.regexp_extract("entity_id", "#([0-9]+)", 1).cast("bigint").alias("source_row_number"))
    return parsed.join(events.select("source_file", "source_row_number", "session_key"), ["source_file", "source_row_number"])


def lane_status(final: DataFrame, checks: DataFrame) -> DataFrame:
    """Core and context outcome. Context problems never block the core results."""
    c = F.col
    context_rule = c("rule_id").isin(*CONTEXT_RULES)
    blocking = c("handling") == "BLOCK"
    fail = c("status") == "FAIL"
    no = F.lit(False)
    from_findings = final.select(
        (blocking & ~context_rule).alias("core_blocked"), (blocking & context_rule).alias("context_blocked"),
        "quarantine", c("rule_id").isin("X01", "X08").alias("gaps"))
    from_checks = checks.select(
        (fail & (c("area") != "context")).alias("core_blocked"), (fail & (c("area") == "context")).alias("context_blocked"),
        no.alias("quarantine"), no.alias("gaps"))
    both = from_findings.unionByName(from_checks).agg(
        *[F.coalesce(F.bool_or(n), no).alias(n) for n in ("core_blocked", "context_blocked", "quarantine", "gaps")])
    return both.select(
        F.when(c("core_blocked"), "BLOCKED").when(c("quarantine"), "PASSED_WITH_QUARANTINE").otherwise("PASSED").alias("core_status"),
        F.when(c("context_blocked"), "BLOCKED").when(c("gaps"), "PASSED_WITH_WARNINGS").otherwise("PASSED").alias("context_status"))
