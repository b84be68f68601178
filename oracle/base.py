"""The role mapping and the measurement in plain SQL, as named steps. An oracle query names the steps it needs."""

from __future__ import annotations

import re

FILE3H = "primary_2024-01-08.csv"
PARAMS = ("purchase", "signup", "view", "click", "error")

STEPS: dict[str, str] = {}


def step(name: str, sql: str) -> None:
    STEPS[name] = sql.strip()


def needs(sql: str) -> list[str]:
    """Steps a text refers to, in the order they must be defined."""
    found: set[str] = set()

    def visit(text: str) -> None:
        for name in STEPS:
            if name not in found and re.search(rf"\b{name}\b", text):
                found.add(name)
                visit(STEPS[name])

    visit(sql)
    return [n for n in STEPS if n in found]


def with_steps(sql: str) -> str:
    names = needs(sql)
    if not names:
        return sql.strip()
    return "WITH " + ",\n".join(f"{n} AS (\n{STEPS[n]}\n)" for n in names) + "\n" + sql.strip()


def utc(t: str) -> str:
    return f"(timezone('UTC', timezone('Europe/Helsinki', {t})))"


def local(t: str) -> str:
    return f"(timezone('Europe/Helsinki', timezone('UTC', {t})))"


def ceil_hour(t: str) -> str:
    return f"(CASE WHEN date_trunc('hour', {t}) = {t} THEN {t} ELSE date_trunc('hour', {t}) + INTERVAL 1 HOUR END)"


def hour_frac(t: str) -> str:
    return f"(hour({t}) + minute({t}) / 60.0 + second({t}) / 3600.0)"


def secs(a: str, b: str) -> str:
    return f"CAST(epoch({b}) - epoch({a}) AS BIGINT)"


def finding_id(rule: str, kind: str, entity: str) -> str:
    return f"'vi-' || sha256({rule} || '|' || {kind} || '|' || {entity})"


step("ev_base", f"""
SELECT event_id AS i, user_id AS u, value, event_type, ts, CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS k,
  CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 10 HOUR
    + to_seconds((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) // 6) AS service_local,
  (CASE WHEN event_type IN ('purchase', 'signup', 'view') OR ts >= TIMESTAMP '2024-01-22' THEN 'primary_' ELSE 'secondary_' END)
    || CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) || '.csv' AS source_file
FROM events""")

step("ev_copy", """
SELECT *, service_local + CASE WHEN i % 503 = 0 THEN INTERVAL 6 HOUR ELSE INTERVAL 0 HOUR END AS true_local,
  unnest(CASE WHEN i % 100 = 7 THEN [0, 1] ELSE [0] END) AS copy_no
FROM ev_base""")

step("ev_times", f"""
SELECT *, true_local - CASE WHEN source_file = '{FILE3H}' THEN INTERVAL 3 HOUR ELSE INTERVAL 0 HOUR END AS wall,
  CAST(CAST(true_local AS DATE) AS TIMESTAMP) + INTERVAL 13 HOUR + INTERVAL 50 MINUTE + to_seconds((u % 5 - 1) * 30 + CASE WHEN i % 307 = 0 THEN 1 ELSE 0 END)
   - CASE WHEN source_file = '{FILE3H}' THEN INTERVAL 3 HOUR ELSE INTERVAL 0 HOUR END AS ident
FROM ev_copy""")

step("cells", """
SELECT source_file, i * 2 + copy_no + 1 AS source_row_number,
  CAST(u AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id,
  CASE WHEN i % 601 = 0 THEN 'EXTRA_CELLS' WHEN i % 607 = 0 THEN 'SHORT_ROW' ELSE 'OK' END AS row_status,
  CASE WHEN i % 601 = 0 THEN '{"blank_header_columns":{"9":"hidden"}}' WHEN i % 613 = 0 THEN '{"extra_columns":{"note":"kept"}}' END AS unmapped,
  (CASE WHEN i % 5 = 0 THEN strftime(wall, '%Y.%m.%d %H:%M:%S') ELSE strftime(wall, '%Y-%m-%d %H:%M:%S') END)
    || CASE WHEN i % 409 = 0 THEN '.5' ELSE '' END AS event_time_raw,
  CASE WHEN source_file LIKE 'primary\\_%' ESCAPE '\\' THEN 'line' END AS weighing_type,
  'st' || (k % 3) || '-' || CASE WHEN k % 7 = 0 THEN '' WHEN k % 2 = 0 THEN 'vasen-' ELSE 'oikea-' END
    || CASE WHEN k % 5 < 2 THEN 'lammin' ELSE 'salaatti' END || (k % 6) AS scale_id,
  CASE WHEN i % 97 = 0 THEN '' WHEN i % 101 = 0 THEN 'x1' ELSE CAST(CAST(floor(value * 10) AS BIGINT) AS VARCHAR) END AS weight_raw,
  CASE WHEN i % 499 = 0 THEN ' ' WHEN i % 7 = 0 THEN '  DISH  ' || (i % 60) || ' ' ELSE 'dish ' || (i % 60) END AS component_raw,
  'tray' || (u % 50) || CASE WHEN i % 211 = 0 THEN 'b' ELSE '' END AS tray_id,
  CASE WHEN i % 401 = 0 THEN 'n/a' WHEN i % 5 = 0 THEN strftime(ident, '%Y.%m.%d %H:%M:%S') ELSE strftime(ident, '%Y-%m-%d %H:%M:%S') END AS ident_time_raw
FROM ev_times""")


def _parse(c: str) -> str:
    return f"COALESCE(try_strptime(trim({c}), '%Y-%m-%d %H:%M:%S'), try_strptime(trim({c}), '%Y.%m.%d %H:%M:%S'))"


step("stg", f"""
SELECT *, {utc('event_local')} AS event_utc, {utc('ident_local')} AS ident_utc,
  CASE WHEN event_local IS NULL THEN 'UNPARSEABLE' ELSE 'OK' END AS event_time_status,
  CASE WHEN ident_local IS NULL THEN 'UNPARSEABLE' ELSE 'OK' END AS ident_time_status
FROM (SELECT *, session_id || '|' || population AS session_key, source_file || '#' || source_row_number AS event_id,
   event_wall + to_hours(tz_offset_hours) AS event_local, ident_wall + to_hours(tz_offset_hours) AS ident_local
  FROM (SELECT *, CASE WHEN starts_with(source_file, 'primary_') THEN 'primary' ELSE 'secondary' END AS population,
     CASE WHEN source_file = '{FILE3H}' THEN 3 ELSE 0 END AS tz_offset_hours,
     CASE WHEN source_file = '{FILE3H}' THEN 'NORMALISED_PLUS_3H' ELSE 'SOURCE_LOCAL_ASSUMED' END AS tz_handling,
     {_parse('event_time_raw')} AS event_wall, {_parse('ident_time_raw')} AS ident_wall,
     nullif(lower(trim(regexp_replace(component_raw, '\\s+', ' ', 'g'))), '') AS component,
     CASE WHEN trim(weight_raw) = '' THEN 'EMPTY' WHEN regexp_full_match(trim(weight_raw), '[0-9]+') THEN 'OK' ELSE 'NOT_INTEGER' END AS weight_status,
     CASE WHEN regexp_full_match(trim(weight_raw), '[0-9]+') THEN CAST(trim(weight_raw) AS BIGINT) END AS weight_g,
     sha256(session_id || chr(31) || event_time_raw || chr(31) || coalesce(weighing_type, '') || chr(31) || scale_id || chr(31) || weight_raw
       || chr(31) || component_raw || chr(31) || tray_id || chr(31) || ident_time_raw) AS row_sha256
   FROM cells))""")

step("marked", """
SELECT *, source_row_number > first_row AS is_repeat,
  CASE WHEN source_row_number > first_row THEN source_file || '#' || first_row END AS repeats_event_id
FROM (SELECT *, min(source_row_number) OVER (PARTITION BY source_file, row_sha256) AS first_row FROM stg)""")

step("fl", """
SELECT *, coalesce(contains(unmapped, 'blank_header_columns'), false) AS s04, row_status <> 'OK' OR coalesce(contains(unmapped, 'extra_columns'), false) AS s08,
  trim(session_id) = '' OR trim(tray_id) = '' OR trim(scale_id) = '' OR trim(component_raw) = '' AS s05,
  weight_status <> 'OK' AS s06, event_time_status <> 'OK' OR ident_time_status <> 'OK' AS s07,
  coalesce(weight_g <= 0, false) AS b01, coalesce(weight_g > 0 AND weight_g >= 1500, false) AS b02,
  coalesce(weight_g > 0 AND weight_g <= 3 AND NOT is_repeat, false) AS b03,
  coalesce(NOT (CAST(event_local AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-29'), false) AS t01,
  coalesce(isodow(event_local) >= 6, false) AS t02,
  coalesce(NOT (hour(event_local) >= 9 AND hour(event_local) < 15), false) AS t03
FROM marked""")

step("prof", """
SELECT session_key, session_id, population, count(*) AS events_staged, count(*) FILTER (NOT is_repeat) AS events_counted,
  count(*) FILTER (is_repeat) AS repeats, string_agg(DISTINCT source_file, ';' ORDER BY source_file) AS source_files,
  min(event_local) FILTER (NOT is_repeat) AS first_local, max(event_local) FILTER (NOT is_repeat) AS last_local,
  min(event_utc) FILTER (NOT is_repeat) AS first_utc, max(event_utc) FILTER (NOT is_repeat) AS last_utc,
  min(ident_utc) FILTER (NOT is_repeat) AS min_ident_utc, max(ident_utc) FILTER (NOT is_repeat) AS max_ident_utc,
  min(ident_local) AS min_ident_local, max(ident_local) AS max_ident_local,
  count(DISTINCT ident_utc) FILTER (NOT is_repeat) AS ident_values,
  min(nullif(tray_id, '')) AS min_tray, max(nullif(tray_id, '')) AS max_tray, count(DISTINCT nullif(tray_id, '')) AS tray_count,
  CASE WHEN count(*) FILTER (NOT is_repeat AND weight_g IS NULL) = 0 THEN CAST(sum(weight_g) FILTER (NOT is_repeat) AS BIGINT) END AS weight_counted,
  CASE WHEN count(*) FILTER (weight_g IS NULL) = 0 THEN CAST(sum(weight_g) AS BIGINT) END AS weight_all,
  count(DISTINCT component) FILTER (NOT is_repeat) AS n_components, count(DISTINCT component_raw) FILTER (NOT is_repeat) AS n_raw_components,
  count(DISTINCT scale_id) FILTER (NOT is_repeat) AS n_scales, bool_or(contains(scale_id, 'lammin')) AS has_hot_scale,
  bool_or(s04) AS s04, bool_or(s08) AS s08, bool_or(s05) AS s05, bool_or(s06) AS s06, bool_or(s07) AS s07, bool_or(b01) AS b01, bool_or(b02) AS b02, bool_or(b03) AS b03,
  bool_or(t01) AS t01, bool_or(t02) AS t02, bool_or(t03) AS t03, bool_or(is_repeat) AS i02
FROM fl GROUP BY ALL""")

step("ses", f"""
SELECT *, s05 OR s06 OR s07 OR b01 OR t01 OR t03 OR in_both OR i04 AS is_quarantined
FROM (SELECT *, count(*) OVER (PARTITION BY session_id) > 1 AS in_both, coalesce(min_tray <> max_tray, false) AS i04,
   coalesce(min_ident_utc <> max_ident_utc, false) AS t06, population = 'primary' AND events_counted = 1 AS b04,
   coalesce(weight_counted < 50 OR weight_counted > 2200, false) AS b07,
   coalesce({secs('first_utc', 'last_utc')} > 7200, false) AS t05, coalesce(min_ident_utc < last_utc, false) AS t04,
   {secs('first_utc', 'last_utc')} AS span_s, {secs('last_utc', 'min_ident_utc')} AS ident_minus_last_s
  FROM prof)""")

step("rep_scales", """
SELECT session_key, string_agg(scale_id || ' x' || n, ';' ORDER BY scale_id || ' x' || n) AS repeated_scales
FROM (SELECT session_key, scale_id, count(*) AS n FROM fl WHERE NOT is_repeat GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL""")

step("ver_rows", """
SELECT f.session_id, f.population, f.scale_id, coalesce(f.weight_g, -1) AS w, f.component, f.event_utc, f.event_wall,
  row_number() OVER (PARTITION BY f.session_id, f.population ORDER BY f.scale_id, coalesce(f.weight_g, -1), f.event_utc NULLS FIRST, f.source_file, f.source_row_number) AS r
FROM fl f JOIN ses s USING (session_key) WHERE NOT f.is_repeat AND s.in_both""")

step("ver", f"""
SELECT session_id, events_a, events_b, same_multiset, CASE WHEN same_multiset THEN lo END AS min_delta_s, CASE WHEN same_multiset THEN hi END AS max_delta_s,
  CASE WHEN same_multiset THEN wlo END AS min_wall_delta_s, CASE WHEN same_multiset THEN whi END AS max_wall_delta_s,
  CASE WHEN same_multiset THEN conflicts ELSE 0 END AS name_conflicts,
  same_multiset AND coalesce(lo, 0) = 0 AND coalesce(hi, 0) = 0 AND conflicts = 0 AS identical
FROM (SELECT session_id, count(a.r) AS events_a, count(b.r) AS events_b,
   bool_and(coalesce(a.scale_id = b.scale_id AND a.w = b.w, false)) AS same_multiset,
   min({secs('a.event_utc', 'b.event_utc')}) AS lo, max({secs('a.event_utc', 'b.event_utc')}) AS hi,
   min({secs('a.event_wall', 'b.event_wall')}) AS wlo, max({secs('a.event_wall', 'b.event_wall')}) AS whi,
   count(*) FILTER (a.component IS DISTINCT FROM b.component) AS conflicts
  FROM (SELECT * FROM ver_rows WHERE population = 'primary') a FULL JOIN (SELECT * FROM ver_rows WHERE population = 'secondary') b USING (session_id, r)
  GROUP BY ALL)""")

_ERR = ("b01", "i01", "i04", "s05", "s06", "s07", "t01", "t03")


def _ids(pairs: list[tuple[str, str]]) -> str:
    return "concat_ws(';', " + ", ".join(f"CASE WHEN {cond} THEN '{rule}' END" for rule, cond in pairs) + ")"


step("sesx", f"""
SELECT s.*, v.identical, r.repeated_scales, r.repeated_scales IS NOT NULL AND NOT s.is_quarantined AS b05, v.identical IS NOT NULL AS i06,
  {_ids([('B01', 's.b01'), ('I01', 's.in_both'), ('I04', 's.i04'), ('S05', 's.s05'), ('S06', 's.s06'), ('S07', 's.s07'), ('T01', 's.t01'), ('T03', 's.t03')])} AS error_rule_ids,
  {_ids([('B02', 's.b02'), ('B04', 's.b04'), ('B07', 's.b07'), ('I02', 's.i02'), ('I06', 'v.identical = false'), ('S04', 's.s04'), ('S08', 's.s08'), ('T02', 's.t02'), ('T04', 's.t04'), ('T05', 's.t05'), ('T06', 's.t06')])} AS warn_rule_ids,
  {_ids([('B03', 's.b03'), ('B05', 'r.repeated_scales IS NOT NULL AND NOT s.is_quarantined'), ('I06', 'v.identical = true')])} AS info_rule_ids,
  s.b04 OR s.b07 OR s.t04 OR s.t05 OR coalesce(v.identical = false, false) AS has_session_warn, s.b02 OR s.i02 AS has_event_warn
FROM ses s LEFT JOIN rep_scales r USING (session_key) LEFT JOIN ver v USING (session_id)""")

step("disp", """
SELECT f.*, CASE WHEN s.is_quarantined THEN 'QUARANTINED' WHEN f.is_repeat THEN 'DUPLICATE_EXCLUDED' ELSE 'MODELLABLE' END AS disposition
FROM fl f JOIN ses s USING (session_key)""")

step("cell_names", """
SELECT scale_id, CAST(event_local AS DATE) AS day, component, bool_or(population = 'primary') AS p, bool_or(population = 'secondary') AS o
FROM stg WHERE event_local IS NOT NULL AND component IS NOT NULL GROUP BY ALL""")

step("agree", """
SELECT scale_id, day, count(*) AS names, count(*) FILTER (p AND o) AS shared, count(*) FILTER (p AND o) / count(*) AS jaccard,
  count(*) FILTER (p AND o) = count(*) AS identical, count(*) FILTER (p AND o) = 0 AS disjoint
FROM cell_names GROUP BY ALL HAVING bool_or(p) AND bool_or(o)""")

step("limited", """
SELECT DISTINCT d.session_key FROM disp d JOIN agree a ON a.scale_id = d.scale_id AND a.day = CAST(d.event_local AS DATE)
WHERE d.disposition = 'MODELLABLE' AND a.disjoint""")

_hour = ceil_hour(utc("service_local"))
step("obs_hours", f"""
SELECT event_type AS parameter, i, CAST(floor(value * 10) AS BIGINT) AS g,
  CASE WHEN day(h) % 7 = 3 AND hour(h) IN (9, 10) THEN CAST(CAST(h AS DATE) AS TIMESTAMP) + INTERVAL 8 HOUR
       WHEN day(h) % 5 = 0 AND hour(h) = 11 AND event_type = 'signup' THEN h + INTERVAL 1 HOUR ELSE h END AS hour
FROM (SELECT *, {_hour} AS h FROM ev_base)""")

step("obs_raw", """
SELECT parameter || '/' || CAST(hour AS VARCHAR) AS observation_id, 'context_' || CAST(CAST(date_trunc('week', hour) AS DATE) AS VARCHAR) || '.xml' AS source_file,
  '100' AS station, replace(CAST(hour AS VARCHAR), ' ', 'T') || 'Z' AS time_raw, parameter, hour AS obs_utc,
  CASE WHEN min(i) % 61 = 0 THEN 'NaN' WHEN min(i) % 53 = 0 THEN 'bad' ELSE CAST(sum(g) // count(*) AS VARCHAR) END AS value_raw
FROM obs_hours GROUP BY parameter, hour""")

step("obs", """
SELECT *, CASE WHEN value_raw = 'NaN' THEN 'NAN_SOURCE_NULL' WHEN value_raw = 'bad' THEN 'UNPARSEABLE' ELSE 'OK' END AS value_status,
  TRY_CAST(CASE WHEN value_raw IN ('NaN', 'bad') THEN NULL ELSE value_raw END AS DOUBLE) AS value FROM obs_raw""")

step("ctx", "SELECT station, obs_utc, " + ", ".join(
    f"max(value) FILTER (parameter = '{p}') AS {p}_value, coalesce(max(value_status) FILTER (parameter = '{p}'), 'MISSING') AS {p}_status" for p in PARAMS)
    + ", string_agg(DISTINCT source_file, ';' ORDER BY source_file) AS source_files, count(*) AS observations FROM obs GROUP BY station, obs_utc")

step("facts", f"""
SELECT s.*, CASE WHEN s.is_quarantined THEN 0 ELSE s.events_counted END AS modellable_event_count,
  CASE WHEN NOT s.is_quarantined THEN s.weight_counted END AS selected_weight_g,
  CASE WHEN NOT s.is_quarantined AND s.events_counted > 0 THEN s.n_components END AS distinct_component_count,
  CASE WHEN NOT s.is_quarantined AND s.events_counted > 0 THEN s.n_raw_components END AS distinct_raw_component_count,
  CAST(s.first_local AS DATE) AS service_date,
  s.population = 'primary' AND NOT s.is_quarantined AND s.events_counted > 0 AND s.error_rule_ids = '' AND s.weight_counted IS NOT NULL AND s.first_utc IS NOT NULL AS core_ready,
  CASE WHEN l.session_key IS NOT NULL THEN 'LIMITED' ELSE 'READY_WITH_LIMITATION' END AS component_count_status,
  CASE WHEN s.is_quarantined THEN NULL ELSE {ceil_hour('s.first_utc')} END AS context_hour_utc
FROM sesx s LEFT JOIN limited l USING (session_key)""")

step("factx", """
SELECT f.*, CASE WHEN f.is_quarantined THEN 'NOT_ATTEMPTED_QUARANTINED' WHEN f.context_hour_utc IS NULL THEN 'NO_TIMESTAMP'
   WHEN c.obs_utc IS NOT NULL THEN 'MATCHED' ELSE 'UNMATCHED_NO_OBSERVATION' END AS context_join_status,
  c.obs_utc IS NOT NULL AS context_matched, c.purchase_status <> 'OK' AS purchase_null, c.signup_status <> 'OK' AS signup_null
FROM facts f LEFT JOIN ctx c ON c.obs_utc = f.context_hour_utc""")


def regime(sessions: str, population: str, day: str) -> str:
    """Regime columns of a day, as text to put into a SELECT."""
    expected = (f"CASE WHEN {population} = 'primary' THEN CASE WHEN isodow({day}) <= 3 THEN 'high' WHEN isodow({day}) <= 5 THEN 'low' END END")
    observed = f"CASE WHEN {sessions} < 45 THEN 'low' ELSE 'high' END"
    return (f"dayname({day}) AS weekday, {observed} AS observed_regime, {expected} AS expected_regime, {population} = 'primary' AND {sessions} < 45 AS low_volume_day, "
            f"coalesce({observed} <> {expected}, false) AS volume_irregularity")


step("vdays", f"""
SELECT population, service_date, sessions, {regime('sessions', 'population', 'service_date')}
FROM (SELECT population, CAST(first_local AS DATE) AS service_date, count(*) AS sessions FROM ses WHERE NOT is_quarantined AND first_local IS NOT NULL GROUP BY ALL)""")

step("volume", f"""
SELECT service_date, population, sessions, quarantined_sessions, events, source_files, {regime('sessions', 'population', 'service_date')}
FROM (SELECT service_date, population, count(*) FILTER (NOT is_quarantined AND modellable_event_count > 0) AS sessions,
   count(*) FILTER (is_quarantined) AS quarantined_sessions, CAST(sum(modellable_event_count) AS BIGINT) AS events,
   string_agg(DISTINCT source_files, ';' ORDER BY source_files) FILTER (NOT is_quarantined) AS source_files
  FROM facts WHERE service_date IS NOT NULL GROUP BY ALL) WHERE sessions > 0""")

step("fhours", f"""
SELECT source_file, basis, CAST(t AS DATE) AS day, {hour_frac('min(t)')} AS h
FROM (SELECT source_file, 'raw' AS basis, event_wall AS t FROM stg WHERE event_wall IS NOT NULL
  UNION ALL SELECT source_file, 'treated', event_local FROM stg WHERE event_local IS NOT NULL) GROUP BY ALL""")

step("fmedian", """
SELECT source_file, quantile_cont(h, 0.5) FILTER (basis = 'raw') AS raw_hour, quantile_cont(h, 0.5) FILTER (basis = 'treated') AS treated_hour
FROM fhours GROUP BY ALL""")

# ---- findings: rule, entity type, entity, session key, event id, population, severity ----------------------------------------------
_EVENT = [("S04", "s04", ""), ("S08", "s08", ""), ("S05", "s05", ""), ("S06", "s06", ""), ("S07", "event_time_status <> 'OK'", "|weighing_event_time"),
          ("S07", "ident_time_status <> 'OK'", "|user_identification_time"), ("B01", "b01", ""), ("B02", "b02", ""), ("B03", "b03", ""),
          ("T01", "t01", ""), ("T02", "t02", ""), ("T03", "t03", ""), ("I02", "is_repeat", "")]
step("find_events", "\nUNION ALL\n".join(
    f"SELECT '{r}' AS rule_id, 'event' AS entity_type, event_id || '{sfx}' AS entity_id, session_key, event_id, population, NULL::VARCHAR AS sev FROM fl WHERE {cond}"
    for r, cond, sfx in _EVENT))
_SESSION = [("I01", "in_both"), ("I04", "i04"), ("T06", "t06"), ("B04", "b04"), ("B07", "b07"), ("T05", "t05"), ("T04", "t04"), ("B05", "b05")]
step("find_sessions", "\nUNION ALL\n".join(
    f"SELECT '{r}' AS rule_id, 'session' AS entity_type, session_key AS entity_id, session_key, '' AS event_id, population, NULL::VARCHAR AS sev FROM sesx WHERE {cond}"
    for r, cond in _SESSION))
step("find_versions", "SELECT 'I06' AS rule_id, 'session_id' AS entity_type, session_id AS entity_id, '' AS session_key, '' AS event_id, 'both' AS population, "
     "CASE WHEN identical THEN 'INFO' END AS sev FROM ver")
step("find_names", "SELECT 'I07' AS rule_id, 'scale_day' AS entity_type, scale_id || '|' || CAST(day AS VARCHAR) AS entity_id, '' AS session_key, '' AS event_id, "
     "'both' AS population, NULL::VARCHAR AS sev FROM agree WHERE disjoint")
step("file_rows", f"""
SELECT source_file, min(population) AS population, bool_or(weighing_type IS NOT NULL) AS has_type,
  bool_or(contains(event_time_raw, '.') AND event_wall IS NOT NULL AND contains(split_part(event_time_raw, ' ', 1), '.')) AS dot_event,
  bool_or(ident_wall IS NOT NULL AND contains(ident_time_raw, '.')) AS dot_ident, min(CAST(event_wall AS DATE)) AS d0, max(CAST(event_wall AS DATE)) AS d1
FROM stg GROUP BY ALL""")
step("find_files", f"""
SELECT 'S03' AS rule_id, 'file' AS entity_type, source_file AS entity_id, '' AS session_key, '' AS event_id, population, NULL::VARCHAR AS sev FROM file_rows WHERE NOT has_type
UNION ALL SELECT 'T08', 'file', source_file, '', '', population, NULL FROM file_rows WHERE dot_event OR dot_ident
UNION ALL SELECT 'T07', 'file', source_file, '', '', f.population, NULL FROM file_rows f JOIN fmedian USING (source_file)
  WHERE NOT (raw_hour >= 10 AND raw_hour < 11 AND treated_hour >= 10 AND treated_hour < 11)
UNION ALL SELECT 'T10', 'file', source_file, '', '', '', NULL FROM file_rows WHERE source_file = '{FILE3H}' AND (d0 < DATE '2024-01-08' OR d1 > DATE '2024-01-14')
UNION ALL SELECT 'T10', 'file', source_file, '', '', '', NULL FROM fmedian WHERE source_file = '{FILE3H}' AND (raw_hour < 7.0 OR raw_hour > 8.5)""")
step("find_days", """
SELECT 'C02a' AS rule_id, 'service_day' AS entity_type, CAST(service_date AS VARCHAR) AS entity_id, '' AS session_key, '' AS event_id, population, NULL::VARCHAR AS sev FROM vdays WHERE low_volume_day
UNION ALL SELECT 'C02b', 'service_day', CAST(service_date AS VARCHAR), '', '', population, NULL FROM vdays WHERE volume_irregularity""")
step("want_days", """
SELECT p.population, CAST(d.d AS DATE) AS day FROM (SELECT DISTINCT population FROM vdays) p,
  (SELECT unnest(generate_series(DATE '2024-01-02', DATE '2024-01-29', INTERVAL 1 DAY)) AS d) d WHERE isodow(d.d) <= 5""")
step("miss_days", "SELECT w.population, w.day FROM want_days w ANTI JOIN vdays v ON v.population = w.population AND v.service_date = w.day")
step("miss_weeks", """
SELECT DISTINCT w.population, CAST(date_trunc('week', w.day) AS DATE) AS week FROM want_days w
WHERE NOT EXISTS (SELECT 1 FROM vdays v WHERE v.population = w.population AND date_trunc('week', v.service_date) = date_trunc('week', w.day))""")
step("find_cover", """
SELECT DISTINCT 'C01' AS rule_id, 'population' AS entity_type, population AS entity_id, '' AS session_key, '' AS event_id, population, NULL::VARCHAR AS sev FROM miss_days
UNION ALL SELECT 'C03', 'population_week', population || '|' || CAST(week AS VARCHAR), '', '', population, NULL FROM miss_weeks""")
step("want_hours", "SELECT unnest(generate_series(TIMESTAMP '2024-01-02 08:00:00', TIMESTAMP '2024-01-29 12:00:00', INTERVAL 1 HOUR)) AS hour")
step("gap_hours", """
SELECT hour, 'missing' AS kind FROM want_hours WHERE hour NOT IN (SELECT obs_utc FROM obs)
UNION ALL SELECT DISTINCT obs_utc, 'unexpected' FROM obs WHERE obs_utc NOT IN (SELECT hour FROM want_hours)""")
step("gaps", """
SELECT kind, min(hour) AS first_hour, max(hour) AS last_hour, count(*) AS hours
FROM (SELECT *, hour - to_hours(row_number() OVER (PARTITION BY kind ORDER BY hour)) AS island FROM gap_hours) GROUP BY kind, island""")
step("miss_params", """
SELECT h.hour, p.parameter FROM want_hours h, (SELECT unnest(['purchase', 'signup', 'view', 'click', 'error']) AS parameter) p
WHERE h.hour IN (SELECT obs_utc FROM obs) AND NOT EXISTS (SELECT 1 FROM obs o WHERE o.obs_utc = h.hour AND o.parameter = p.parameter)""")
step("find_context", """
SELECT 'X07' AS rule_id, 'context_observation' AS entity_type, observation_id || '|value' AS entity_id, '' AS session_key, '' AS event_id, '' AS population, NULL::VARCHAR AS sev FROM obs WHERE value_status = 'UNPARSEABLE'
UNION ALL SELECT 'X03', 'context_observation', observation_id, '', '', '', NULL FROM obs WHERE value_status = 'NAN_SOURCE_NULL'
UNION ALL SELECT 'X01', 'context_hours', kind || ' ' || CAST(first_hour AS VARCHAR) || '..' || CAST(last_hour AS VARCHAR), '', '', '', NULL FROM gaps
UNION ALL SELECT DISTINCT 'X08', 'context_parameter', parameter, '', '', '', NULL FROM miss_params""")
step("find_core", "SELECT * FROM find_events UNION ALL SELECT * FROM find_sessions UNION ALL SELECT * FROM find_versions UNION ALL SELECT * FROM find_names UNION ALL SELECT * FROM find_files")
step("find_all", "SELECT * FROM find_core UNION ALL SELECT * FROM find_days UNION ALL SELECT * FROM find_cover UNION ALL SELECT * FROM find_context")

_CAT = """S03 structure INFO FLAG,S04 structure WARN FLAG,S05 structure ERROR QUARANTINE,S06 structure ERROR QUARANTINE,S07 structure ERROR QUARANTINE,S08 structure WARN FLAG,
B01 business ERROR QUARANTINE,B02 business WARN FLAG,B03 business INFO FLAG,B04 business WARN FLAG,B05 business INFO FLAG,B07 business WARN FLAG,
T01 time ERROR QUARANTINE,T02 time WARN FLAG,T03 time ERROR QUARANTINE,T04 time WARN FLAG,T05 time WARN FLAG,T06 time WARN FLAG,T07 time WARN FLAG,T08 time INFO FLAG,T10 time ERROR BLOCK,
I01 identity ERROR QUARANTINE,I02 identity WARN KEEP_FIRST,I04 identity ERROR QUARANTINE,I06 identity WARN FLAG,I07 identity INFO FLAG,
X01 context WARN FLAG,X03 context INFO FLAG,X04 context ERROR BLOCK,X07 context ERROR BLOCK,X08 context WARN FLAG,
C01 coverage WARN FLAG,C02a coverage INFO FLAG,C02b coverage WARN FLAG,C03 coverage WARN FLAG,C04 coverage ERROR BLOCK"""
step("cat", "SELECT * FROM (VALUES " + ", ".join(
    "(%d, '%s', '%s', '%s', '%s')" % (n, *r.split()) for n, r in enumerate(_CAT.replace("\n", "").split(","))) + ") AS t(rule_order, rule_id, category, severity, handling)")
step("fin", f"""
SELECT {finding_id('f.rule_id', 'f.entity_type', 'f.entity_id')} AS finding_id, f.rule_id, c.rule_order, c.category, coalesce(f.sev, c.severity) AS severity, c.handling,
  c.handling = 'QUARANTINE' AS quarantine, f.entity_type, f.entity_id, f.session_key, f.event_id, f.population
FROM find_all f JOIN cat c USING (rule_id)""")
