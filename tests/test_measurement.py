from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from measurekit.operators import checks as K
from measurekit.operators import facts as FA
from measurekit.operators import findings as FI
from measurekit.operators import metrics as M
from measurekit.operators import profiles as P
from measurekit.operators import repeats as R
from measurekit.operators import rules_context as RC
from measurekit.operators import rules_events as RE
from measurekit.operators import rules_files as RF
from measurekit.operators import rules_sessions as RS
from measurekit.operators import rules_volume as RV
from measurekit.operators import scenarios as SC
from tests.builders import CFG, hits, measure, one, row


def events(m):
    return RE.event_findings(m.flagged, CFG)


def test_weight_rules_at_their_bounds(spark):
    m = measure(spark, [row(i, weight_of_a_component=w) for i, w in enumerate(["-1", "0", "3", "4", "1499", "1500", ""], 1)])
    f = events(m).cache()
    assert hits(f, "S06") == ["registered_a.csv#1", "registered_a.csv#7"]
    assert hits(f, "B01") == ["registered_a.csv#2"]
    assert hits(f, "B03") == ["registered_a.csv#3"]
    assert hits(f, "B02") == ["registered_a.csv#6"]


def test_trace_rule_leaves_repeats_out_and_large_rule_does_not(spark):
    same = dict(weighing_event_time="2020-10-06 11:00:00")
    m = measure(spark, [row(1, weight_of_a_component="2", **same), row(2, weight_of_a_component="2", **same),
                        row(3, weight_of_a_component="1600", **same), row(4, weight_of_a_component="1600", **same)])
    f = events(m).cache()
    assert hits(f, "B03") == ["registered_a.csv#1"]
    assert hits(f, "B02") == ["registered_a.csv#3", "registered_a.csv#4"]
    assert hits(f, "I02") == ["registered_a.csv#2", "registered_a.csv#4"]


def test_time_rules(spark):
    times = ["2020-10-06 08:59:59", "2020-10-06 09:00:00", "2020-10-06 14:59:59", "2020-10-06 15:00:00", "2020-10-04 11:00:00", "2020-10-10 11:00:00", "x"]
    f = events(measure(spark, [row(i, weighing_event_time=t) for i, t in enumerate(times, 1)])).cache()
    assert hits(f, "T03") == ["registered_a.csv#1", "registered_a.csv#4"]
    assert hits(f, "T01") == ["registered_a.csv#5"]
    assert hits(f, "T02") == ["registered_a.csv#5", "registered_a.csv#6"]
    assert hits(f, "S07") == ["registered_a.csv#7|weighing_event_time"]


def test_missing_text_and_clock_change(spark):
    m = measure(spark, [row(1, component_name=" ", tray_id=""), row(2, weighing_event_time="2020-10-25 03:30:00")])
    s05 = one(events(m), rule_id="S05")
    assert s05["observed_value"] == "tray_id,component_name"
    staged = {r["source_row_number"]: r for r in m.staged.collect()}
    assert staged[2]["event_time_status"] == "AMBIGUOUS" and staged[2]["event_utc"] is None and staged[2]["event_local"] is not None


def test_repeats_need_the_same_file_and_every_cell(spark):
    t = dict(weighing_event_time="2020-10-06 11:00:00")
    m = measure(spark, [row(1, **t), row(2, **t), row(3, source_file="registered_b.csv", **t), row(4, weight_of_a_component="90", **t)])
    marked = {(r["source_file"], r["source_row_number"]): (r["is_repeat"], r["repeats_event_id"]) for r in R.mark_repeats(m.staged).collect()}
    assert marked[("registered_a.csv", 2)] == (True, "registered_a.csv#1")
    assert [k for k, v in marked.items() if v[0]] == [("registered_a.csv", 2)]
    s = one(m.session_flags, session_key="s1|primary")
    assert (s["events_staged"], s["events_counted"], s["weight_counted"], s["weight_all"]) == (4, 3, 290, 390)


def test_session_rules_at_their_bounds(spark):
    rows, n = [], 0
    for sid, weight in (("a", "49"), ("b", "50"), ("c", "2200"), ("d", "2201"), ("e", "")):
        n += 1
        rows.append(row(n, session_id=sid, weight_of_a_component=weight, tray_id=sid))
    for sid, second in (("f", "11:10:00"), ("g", "11:10:01")):
        rows += [row(n + 1, session_id=sid, weighing_event_time="2020-10-06 11:00:00", user_identification_time="2020-10-06 11:10:00"),
                 row(n + 2, session_id=sid, weighing_event_time=f"2020-10-06 {second}", user_identification_time="2020-10-06 11:10:00")]
        n += 2
    rows += [row(n + 1, session_id="h"), row(n + 2, session_id="h", tray_id="t2", user_identification_time="2020-10-06 11:06:00")]
    m = measure(spark, rows)
    f = RS.session_findings(m.sessions, CFG).cache()
    assert hits(f, "B07") == ["a|primary", "d|primary"]
    assert hits(f, "T05") == ["g|primary"]
    assert hits(f, "T04") == ["g|primary"]
    assert hits(f, "I04") == ["h|primary"] == hits(f, "T06")
    assert hits(f, "B04") == [f"{s}|primary" for s in "abcde"]
    assert hits(f, "B05") == ["f|primary", "g|primary"]          # h is quarantined


CROSS = dict(source_file="non_registered_a.csv")


def test_crossover_is_quarantined_and_versions_are_compared(spark):
    t = dict(weighing_event_time="2020-10-06 11:00:00")
    m = measure(spark, [row(1, **t), row(2, **t, **CROSS), row(3, session_id="s2", **t), row(4, session_id="s2", weight_of_a_component="90", **t, **CROSS),
                        row(5, session_id="s3", **t), row(6, session_id="s3", component_name="soup", **t, **CROSS), row(7, session_id="s4")])
    assert {r["session_id"]: (r["same_multiset"], r["name_conflicts"], r["identical"]) for r in m.versions.collect()} == {
        "s1": (True, 0, True), "s2": (False, 0, False), "s3": (True, 1, False)}
    assert {r["session_key"] for r in m.session_flags.where("is_quarantined").collect()} == {f"{s}|{p}" for s in ("s1", "s2", "s3") for p in ("primary", "other")}
    warn = {r["session_key"]: (r["warn_rule_ids"], r["info_rule_ids"]) for r in m.sessions.collect()}
    assert "I06" in warn["s2|primary"][0] and "I06" in warn["s1|other"][1] and "I06" not in warn["s1|other"][0]


def test_null_is_never_zero_and_quarantine_never_deletes(spark):
    m = measure(spark, [row(1), row(2, session_id="bad", weight_of_a_component="x"), row(3, session_id="bad")])
    facts = {r["session_key"]: r for r in FA.fact_session(m.sessions, CFG).collect()}
    bad = facts["bad|primary"]
    assert (bad["selected_weight_g"], bad["distinct_component_count"], bad["core_ready"], bad["quarantined_event_count"]) == (None, None, False, 2)
    assert bad["first_weighing_local"] is not None
    assert m.disposed.count() == 3
    assert {r["disposition"] for r in m.disposed.where("session_id = 'bad'").collect()} == {"QUARANTINED"}


def test_fixed_denominator_and_unknown_population(spark):
    m = measure(spark, [row(1), row(2, session_id="bad", weight_of_a_component="x"), row(3, session_id="o", **CROSS)])
    got = {r["metric_id"]: r for r in M.compute(m.facts, CFG, ("M1", "M3", "M5", "W1")).collect()}
    assert (got["M5"]["numerator"], got["M5"]["denominator"], got["M5"]["value"]) == (1, 2, 50.0)
    assert got["M1"]["value"] == 100.0 and got["M3"]["value"] == 1.0 and got["W1"]["value"] is None and got["W1"]["status"] == "BLOCKED"
    with pytest.raises(KeyError):
        M.select_population(m.facts, "everyone", CFG)


def test_empty_population_gives_null(spark):
    m = measure(spark, [row(1, **CROSS)])
    got = one(M.compute(m.facts, CFG, ("M1",)), metric_id="M1")
    assert got["value"] is None and got["n_used"] == 0


def test_judge(spark):
    m = measure(spark, [row(1), row(2, session_id="bad", weight_of_a_component="x")])
    res = M.compute(m.facts, CFG, ("M1", "M5"))
    good = [M.Contract("M1", M.D_CORE, 100, 0), M.Contract("M5", M.D_CORE, 50, 0.005, (1, 2))]
    assert {r["verdict"] for r in M.judge(res, M.contract_table(res, good)).collect()} == {"PASS"}
    bad = [M.Contract("M1", M.C_ELIGIBLE, 101, 0.5), M.Contract("M5", M.D_CORE, 50, 0.005, (1, 1))]
    reasons = {r["metric_id"]: r["reasons"] for r in M.judge(res, M.contract_table(res, bad)).collect()}
    assert reasons == {"M1": "population is not the contract's; value outside tolerance", "M5": "counts differ"}


def test_names_across_populations_limit_component_counts(spark):
    m = measure(spark, [row(1), row(2, session_id="o", component_name="soup", **CROSS), row(3, session_id="p", scale_identifier="k-lammin1", component_name="Rice "),
                        row(4, session_id="q", scale_identifier="k-lammin1", component_name="rice", **CROSS)])
    assert hits(RS.name_findings(m.agreement), "I07") == ["koti2-vasen-salaatti3|2020-10-06"]
    limited = {r["session_key"] for r in FA.limited_sessions(m.disposed, m.agreement).collect()}
    assert limited == {"s1|primary", "o|other"}


def test_file_rules_and_override_scope(spark):
    ok = [row(i, source_file="registered_shifted.csv", session_id=f"x{i}", weighing_event_time=f"2020-10-0{i} 07:30:00", user_identification_time=f"2020-10-0{i} 07:35:00") for i in (6, 7)]
    late = [row(9, source_file="registered_c.csv", session_id="y", weighing_event_time="2020.10.06 12:00:00", weighting_type="")]
    m = measure(spark, ok + late)
    f = RF.file_findings(RF.file_profile(m.staged), CFG).cache()
    assert hits(f, "S03") == ["registered_c.csv"] == hits(f, "T08")
    assert hits(f, "T07") == ["registered_c.csv", "registered_shifted.csv"]
    assert hits(f, "T10") == []
    assert RF.scope_findings(m.staged, CFG).count() == 0
    wrong = m.staged.withColumn("tz_offset_hours", F.when(F.col("source_file") == "registered_c.csv", 3).otherwise(F.col("tz_offset_hours")))
    assert hits(RF.scope_findings(wrong, CFG), "T10") == ["registered_c.csv#9"]
    unshifted = [row(1, source_file="registered_shifted.csv", weighing_event_time="2020-10-06 10:30:00"), row(2, source_file="registered_shifted.csv", weighing_event_time="2020-10-20 10:30:00")]
    bad = measure(spark, unshifted)
    assert len(hits(RF.file_findings(RF.file_profile(bad.staged), CFG), "T10")) == 2


def test_volume_flags_and_missing_days(spark):
    rows = [row(i, session_id=f"m{i}", weighing_event_time="2020-10-05 11:00:00") for i in range(1, 31)]        # Monday: 30, high
    rows += [row(100 + i, session_id=f"t{i}", weighing_event_time="2020-10-06 11:00:00") for i in range(29)]     # Tuesday: 29, low
    m = measure(spark, rows)
    days = RV.service_days(m.session_flags, CFG)
    f = RV.volume_findings(days, CFG).cache()
    assert hits(f, "C02a") == ["2020-10-06"] == hits(f, "C02b")
    assert {r["weekday"]: r["regime"] for r in RV.baseline_regimes(days, CFG).collect()} == {"Monday": "high", "Tuesday": "low"}
    cover = RV.coverage_findings(days, CFG).cache()
    assert hits(cover, "C01") == ["primary"] and len(hits(cover, "C03")) == 6


def obs(time, parameter, value, station="100"):
    return (f"{station}/{parameter}/{time}", "w.xml", station, time, parameter, value)


def test_context_rules_and_join(spark):
    rows = [obs(f"2020-10-06T{h:02d}:00:00Z", p, "1.5") for h in (6, 7, 8, 10, 11, 12) for p in ("t2m", "r_1h") if not (h == 7 and p == "r_1h")]
    rows[0] = obs("2020-10-06T06:00:00Z", "t2m", "NaN")
    m = measure(spark, [row(1, weighing_event_time="2020-10-06 11:00:00"), row(2, session_id="s2", weighing_event_time="2020-10-06 11:00:01"),
                        row(3, session_id="s3", weighing_event_time="2020-10-06 09:30:00"), row(4, session_id="s4", weight_of_a_component="x")], rows)
    f = RC.context_findings(m.observations, CFG).cache()
    assert hits(f, "X01") == ["missing 2020-10-06 09:00:00..2020-10-06 09:00:00"]
    assert hits(f, "X08") == ["r_1h"] and len(hits(f, "X03")) == 1 and hits(f, "X07") == []
    context = {str(r["obs_utc"]): r for r in m.context.collect()}
    assert context["2020-10-06 06:00:00"]["t2m_value"] is None and context["2020-10-06 06:00:00"]["t2m_status"] == "NAN_SOURCE_NULL"
    assert context["2020-10-06 07:00:00"]["r_1h_status"] == "MISSING"
    status = {r["session_id"]: r["context_join_status"] for r in m.facts_with_context.collect()}
    assert status == {"s1": "MATCHED", "s2": "UNMATCHED_NO_OBSERVATION", "s3": "MATCHED", "s4": "NOT_ATTEMPTED_QUARANTINED"}
    blocked = FA.join_context(m.facts, None, CFG)
    assert {r["session_id"]: r["context_join_status"] for r in blocked.collect()}["s1"] == "WEATHER_BLOCKED"


def test_context_grain_faults(spark):
    rows = [obs("2020-10-06T06:00:00Z", "t2m", "1"), obs("2020-10-06T06:00:00Z", "t2m", "2"), obs("2020-10-06T07:30:00Z", "t2m", "1"), obs("2020-10-06T08:00:00Z", "snow", "1"),
            obs("x", "t2m", "1"), obs("2020-10-06T09:00:00Z", "t2m", "?"), obs("2020-10-06T10:00:00Z", "t2m", "1", "200")]
    m = measure(spark, [row(1)], rows)
    got = hits(RC.context_findings(m.observations, CFG), "X07")
    assert sorted(g.rsplit("|", 1)[1] for g in got) == ["grain", "grain", "hour", "parameter", "station", "time", "value"]
    with pytest.raises(Exception, match="context grain"):
        m.context.collect()


def test_hour_convention(spark):
    slots = spark.sql("SELECT timestamp_ntz'2020-10-06 06:00:00' + make_dt_interval(0, 0, 10 * CAST(id AS INT)) AS t, CAST(id AS DOUBLE) AS amount FROM range(1, 13)")
    hourly = spark.sql("SELECT timestamp_ntz'2020-10-06 07:00:00' AS hour, 21.0D AS total")
    got = RC.convention_mae(hourly, slots).first()
    assert (got["hours"], got["mae_ending"], got["mae_starting"]) == (1, 0.0, 30.0)


def test_findings_are_final_unique_and_known(spark):
    m = measure(spark, [row(1, weighing_event_time="x", user_identification_time="y")])
    final = FI.refuse_bad(events(m), CFG)
    assert final.count() == 2
    assert {r["finding_id"][:3] for r in final.collect()} == {"vi-"}
    with pytest.raises(ValueError, match="not unique"):
        FI.refuse_bad(events(m).unionByName(events(m)), CFG)
    with pytest.raises(ValueError, match="unknown rule"):
        FI.refuse_bad(events(m).withColumn("rule_id", F.lit("Z99")), CFG)


def test_handling_from_config_decides_quarantine(spark):
    strict = replace(CFG, rule_overrides={"B02": ("ERROR", "QUARANTINE"), "I04": ("WARN", "FLAG")})
    m = measure(spark, [row(1, weight_of_a_component="1600"), row(2, session_id="h"), row(3, session_id="h", tray_id="t2")], cfg=strict)
    assert {r["session_key"] for r in m.session_flags.where("is_quarantined").collect()} == {"s1|primary"}


def test_two_paths_to_session_status_agree(spark):
    m = measure(spark, [row(1), row(2, weight_of_a_component="1600"), row(3, session_id="b", weight_of_a_component="x"), row(4, session_id="b", **CROSS), row(5, session_id="c", **CROSS)])
    final = FI.finalise(events(m).unionByName(RS.session_findings(m.sessions, CFG)).unionByName(RS.version_findings(m.versions)), CFG)
    by_findings = {r["session_key"]: tuple(r)[1:] for r in FI.session_rule_ids(FI.findings_by_session(final, m.session_flags)).collect()}
    for r in m.sessions.collect():
        direct = (r["error_rule_ids"], r["warn_rule_ids"], r["info_rule_ids"], r["has_session_warn"], r["has_event_warn"])
        assert by_findings.get(r["session_key"], ("", "", "", False, False)) == direct
    assert {r["session_key"] for r in FI.quarantine_keys(final).collect()} == {r["session_key"] for r in m.session_flags.where("is_quarantined").collect()}


def test_checks_pass_on_good_data_and_fail_on_faults(spark):
    m = measure(spark, [row(1), row(2, session_id="s2"), row(3, session_id="o", **CROSS)])
    pins = m.raw.groupBy("source_file").agg(F.count("*").alias("pinned_rows"))
    recon = K.file_reconciliation(m.staged)
    assert {r["status"] for r in K.event_checks(m.controls, pins, recon).collect()} == {"PASS", "INFO"}
    wrong = pins.withColumn("pinned_rows", F.col("pinned_rows") + 1)
    failed = {r["check_id"] for r in K.event_checks(m.controls, wrong, recon).collect() if r["status"] == "FAIL"}
    assert "E01" in failed and "E03:registered_a.csv" in failed
    assert {r["weight_control"] for r in K.session_controls(m.facts, K.rebuilt_sessions(m.controls)).collect()} == {"MATCH"}
    tampered = m.disposed.withColumn("weight_g", F.when(F.col("session_id") == "s2", 1).otherwise(F.col("weight_g")))
    assert [r["session_key"] for r in K.session_controls(m.facts, K.rebuilt_sessions(K.event_controls(tampered))).collect() if r["weight_control"] == "MISMATCH"] == ["s2|primary"]


def test_lane_status(spark):
    m = measure(spark, [row(1), row(2, session_id="bad", weight_of_a_component="x")])
    final = FI.finalise(events(m), CFG)
    checks = K.structure_checks(m.staged)
    assert tuple(FI.lane_status(final, checks).first()) == ("PASSED_WITH_QUARANTINE", "PASSED")
    context_fail = checks.withColumn("area", F.lit("context")).withColumn("status", F.lit("FAIL"))
    assert tuple(FI.lane_status(final, context_fail).first()) == ("PASSED_WITH_QUARANTINE", "BLOCKED")
    assert FI.lane_status(final, checks.withColumn("status", F.lit("FAIL"))).first()["core_status"] == "BLOCKED"


def test_scenario_registry_is_refused_when_wrong(spark):
    s00 = SC.Scenario("S00", "baseline", {"kind": "baseline"})
    for bad in ((s00, s00), (SC.Scenario("S1", "x", {"kind": "baseline"}),), (s00, SC.Scenario("S1", "x", {"kind": "nope"})), (s00, SC.Scenario("G", "g", {"kind": "pooled"}))):
        with pytest.raises(ValueError):
            SC.check_registry(bad)
    with pytest.raises(ValueError):
        SC.date_selector({"kind": "exclude_dates"})


def test_tray_overlap_counts_pairs(spark):
    def session(n, sid, start, end):
        return [row(n, session_id=sid, weighing_event_time=f"2020-10-06 {start}"), row(n + 1, session_id=sid, weighing_event_time=f"2020-10-06 {end}")]
    rows = session(1, "a", "11:00:00", "11:10:00") + session(3, "b", "11:10:00", "11:20:00") + session(5, "c", "11:20:01", "12:30:00") + session(7, "d", "10:00:00", "13:00:00")
    m = measure(spark, rows)
    got = RS.tray_overlaps(m.session_flags).first()
    assert (got["sessions"], got["overlapping_pairs"]) == (4, 4)          # a-b touch, d covers all three


def test_hot_group_of_copies(spark):
    t = dict(weighing_event_time="2020-10-06 11:00:00")
    m = measure(spark, [row(i, **t) for i in range(1, 501)] + [row(600, session_id="z")])
    s = one(m.session_flags, session_key="s1|primary")
    assert (s["events_staged"], s["events_counted"], s["repeats"], s["weight_counted"]) == (500, 1, 499, 100)
    assert R.inversions(m.staged).first()["inversions"] == 0


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_results_do_not_depend_on_partitioning(spark, partitions):
    rows = [row(i, session_id=f"s{i % 17}", weight_of_a_component=str(i), tray_id=f"t{i % 17}", component_name=f"c{i % 5}", source_file="registered_a.csv" if i % 3 else "non_registered_a.csv") for i in range(1, 200)]
    expected = sorted(map(str, measure(spark, rows).facts.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        m = measure(spark, list(reversed(rows)))
        m.raw = m.raw.repartition(5)
        assert sorted(map(str, m.facts.collect())) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_round_trip_rule_and_lineage(spark):
    m = measure(spark, [row(1), row(2), row(3, session_id="one")])
    moved = m.staged.withColumn("event_utc", F.when(F.col("source_row_number") == 1, F.col("event_utc") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("event_utc")))
    flagged = RE.flag_events(R.mark_repeats(moved), CFG)
    assert hits(RE.event_findings(flagged, CFG), "X04") == ["registered_a.csv#1|weighing_event_time"]
    final = FI.finalise(events(m).unionByName(RS.session_findings(m.sessions, CFG)), CFG)
    rows = FI.lineage(final, m.staged).join(final.select("finding_id", "rule_id", "entity_id"), "finding_id")
    assert sorted((r["rule_id"], r["entity_id"], r["event_id"]) for r in rows.collect()) == [
        ("B04", "one|primary", "registered_a.csv#3"), ("B05", "s1|primary", "registered_a.csv#1"), ("B05", "s1|primary", "registered_a.csv#2")]


def scenario_rows(spark):
    rows = []
    for i, grams in enumerate((100, 200, 300, 400, 2500), 1):
        rows += [row(2 * i, session_id=f"s{i}", weight_of_a_component=str(grams // 2), tray_id=f"t{i}", weighing_event_time=f"2020-10-06 11:0{i}:00", component_name="a"),
                 row(2 * i + 1, session_id=f"s{i}", weight_of_a_component=str(grams - grams // 2), tray_id=f"t{i}", weighing_event_time=f"2020-10-06 11:0{i}:30", component_name="A ")]
    rows += [row(50, session_id="x", weight_of_a_component="600"),
             row(51, session_id="x", weight_of_a_component="600", weighing_event_time="2020-10-06 11:00:50", **CROSS), row(60, session_id="o", weight_of_a_component="50", **CROSS)]
    return rows


def test_scenarios_by_hand(spark):
    import datetime as dt

    m = measure(spark, scenario_rows(spark))
    registry = SC.default_registry(CFG, (dt.date(2020, 11, 16), dt.date(2020, 11, 20)), dt.date(2020, 10, 19))
    ws = SC.with_bounds(SC.working_set(m.sessions, CFG), m.flagged, m.volume, CFG)
    results = SC.run_scenarios(ws, registry, CFG)
    got = {r["scenario_id"]: r for r in results.collect()}
    assert (got["S00"]["m1"], got["S00"]["m3"], got["S00"]["m5_numerator"], got["S00"]["m5_denominator"]) == (300.0, 5, 5, 6)
    assert (got["S01"]["m1"], got["S01"]["m3"], got["S01"]["m5"]) == (350.0, 6, 100.0)      # the crossover session comes in with its own weight
    assert got["S02"]["m3"] == 6 and got["S03"]["m3"] == 5                                   # its two versions are identical
    assert got["S04"]["m3"] == 4 and got["S04"]["m1"] == 250.0
    assert got["S05"]["m3"] == 5 and got["S07"]["m3"] == 4
    assert got["S30"]["m4"] == 2.0 and got["S00"]["m4"] == 1.0 and got["S32"]["m4"] == 2.0
    assert (got["S40"]["m3"], got["S40"]["m1"], got["G01"]["m3"]) == (1, 50.0, 6)
    assert "S23" not in got                                                                    # every session lies before its date: no row, never a zero
    deltas = {(r["metric_id"], r["scenario_id"]): r["robustness_class"] for r in SC.metric_deltas(results, registry).collect()}
    assert deltas[("M1", "S01")] == "CONDITIONAL" and deltas[("M1", "G01")] == "NOT_CLASSIFIED" and deltas[("M1", "TZ3")] == "STABLE"


def test_a_broken_partition_blocks_the_core(spark):

    m = measure(spark, [row(1), row(2)])
    whole, broken = m.disposed, m.disposed.withColumn("disposition", F.when(F.col("source_row_number") == 2, "LOST").otherwise(F.col("disposition")))
    assert K.partition_findings(K.event_controls(whole)).count() == 0
    found = FI.finalise(K.partition_findings(K.event_controls(broken)), CFG)
    assert [(r["rule_id"], r["handling"], r["observed_value"]) for r in found.collect()] == [("C04", "BLOCK", "1 of 2")]
    checks = K.structure_checks(m.staged)
    assert FI.lane_status(found, checks).first()["core_status"] == "BLOCKED"
    lane = FI.lane_status(found.limit(0), checks.unionByName(K.context_unusable(spark, "no file"))).first()
    assert (lane["core_status"], lane["context_status"]) == ("PASSED", "BLOCKED")


def test_day_flags_of_a_session(spark):
    m = measure(spark, [row(1)])
    flags = P.with_day_flags(m.session_flags, m.volume).select("session_key", "low_volume_day").collect()
    assert [tuple(r) for r in flags] == [("s1|primary", True)]


def scans_of(df, table: str) -> int:
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    nodes = [leaves.apply(k) for k in range(leaves.size())]
    return sum(n.getClass().getSimpleName() == "LogicalRelation" and n.relation().location().rootPaths().mkString(" ").endswith(f"/{table}") for n in nodes)


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_checks_read_the_events_a_few_times_at_most(spark):
    from measurekit.plans import queries

    seen = {name: scans_of(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), "events") for name in ("check_E", "check_M", "check_MC")}
    assert max(seen.values()) <= 4, seen
