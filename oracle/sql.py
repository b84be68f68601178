"""Oracle SQL for the registered queries, by name."""

from __future__ import annotations

from oracle.base import FILE3H, PARAMS, ceil_hour, finding_id, hour_frac, local, secs, step, utc, with_steps

SQL: dict[str, str] = {}


def add(name: str, sql: str) -> None:
    SQL[name] = sql


def t(c: str, alias: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {alias or c.split('.')[-1]}"


def r6(e: str, alias: str) -> str:
    return f"round(CAST({e} AS DOUBLE), 6) AS {alias}"


def q(c: str, p: float) -> str:
    return f"quantile_cont({c}, {p})"


def pct(num: str, den: str) -> str:
    return f"CASE WHEN {den} > 0 THEN 100.0 * {num} / {den} END"


# ---- sources ------------------------------------------------------------------------------------------------------------------------
# the rows that lines written from events stand for, as cells
step("drift_cells", """
SELECT event_type || '_' || CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) || '.csv' AS source_file, i, event_type AS kind, note, amount, clock, stray,
  row_number() OVER (PARTITION BY event_type, date_trunc('week', ts) ORDER BY i) AS source_row_number,
  CASE WHEN i % 19 = 0 AND NOT stray THEN cells[1:1] WHEN i % 17 = 0 AND NOT stray THEN list_concat(cells, ['more', 'cells']) ELSE cells END AS cells,
  CASE event_type WHEN 'view' THEN ['amount', 'event_id', '', 'ts'] WHEN 'signup' THEN ['event_id', 'ts', 'amount']
    WHEN 'purchase' THEN ['event_id', 'ts', 'amount', 'note', 'extra'] ELSE ['event_id', 'ts', 'amount', 'note'] END AS header
FROM (SELECT *, CASE event_type WHEN 'view' THEN [amount, CAST(i AS VARCHAR), hidden, clock] WHEN 'signup' THEN [CAST(i AS VARCHAR), clock, amount]
    WHEN 'purchase' THEN [CAST(i AS VARCHAR), clock, amount, note, 'e' || i] ELSE [CAST(i AS VARCHAR), clock, amount, note] END AS cells
  FROM (SELECT event_id AS i, event_type, ts, CAST(CAST(floor(value * 10) AS BIGINT) AS VARCHAR) AS amount, strftime(ts, '%Y-%m-%d %H:%M:%S') AS clock,
      event_type = 'error' AND event_id % 997 = 0 AS stray, CASE WHEN event_id % 13 = 0 THEN 'hidden' ELSE '' END AS hidden,
      CASE WHEN event_type = 'error' AND event_id % 997 = 0 THEN 'never closed'
        WHEN event_type IN ('click', 'purchase') AND event_id % 11 = 0 THEN 'line one' || chr(10) || 'line two, "x" ' || event_id
        WHEN event_type IN ('click', 'purchase') AND event_id % 11 = 1 THEN 'a, b' WHEN event_type IN ('click', 'purchase') AND event_id % 11 = 2 THEN 'say "hi"'
        ELSE 'n' || event_id END AS note FROM events))""")
add("src03_xml_elements", """SELECT event_id, CASE WHEN reason IS NULL THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS time_raw, CASE WHEN reason IS NULL THEN event_type END AS parameter,
  CASE WHEN reason IS NULL THEN CASE WHEN event_id % 43 = 0 THEN 'a < b & c' ELSE CAST(CAST(floor(value * 10) AS BIGINT) AS VARCHAR) END END AS value_raw, reason AS reject_reason
  FROM (SELECT *, CASE WHEN event_id % 31 = 0 THEN 'MALFORMED' WHEN event_id % 37 = 0 THEN 'NO_TIME' WHEN event_id % 41 = 0 THEN 'NO_PARAMETER' END AS reason FROM events)""")
FILES = "(SELECT DISTINCT source_file FROM cells)"
add("join11_files_vs_pins", f"""SELECT source_file, CASE WHEN source_file LIKE '%-22.csv' THEN 'UNEXPECTED' WHEN source_file LIKE '%-08.csv' THEN 'SIZE_MISMATCH' WHEN source_file LIKE '%-15.csv' THEN 'CHECKSUM_MISMATCH'
  WHEN source_file LIKE 'secondary\\_2024-01-01%' ESCAPE '\\' THEN 'ROW_COUNT_MISMATCH' ELSE 'OK' END AS status FROM {FILES} UNION ALL SELECT 'gone.csv', 'MISSING'""")
add("join12_inventory_changes", f"""SELECT source_file, CASE WHEN source_file LIKE '%-22.csv' THEN 'appeared' ELSE 'changed' END AS change
  FROM {FILES} WHERE source_file LIKE '%-22.csv' OR source_file LIKE '%-15.csv' UNION ALL SELECT 'gone.csv', 'disappeared'""")
CELL = "CASE WHEN list_contains(header, '{0}') THEN coalesce(cells[list_position(header, '{0}')], '') END"
add("src01_cells", f"""SELECT source_file, source_row_number, {CELL.format('event_id')} AS event_id, {CELL.format('ts')} AS ts, {CELL.format('amount')} AS amount, {CELL.format('note')} AS note,
  CASE WHEN stray THEN 'OPEN_QUOTE' WHEN len(cells) < greatest(list_position(header, 'event_id'), list_position(header, 'ts'), list_position(header, 'amount')) THEN 'SHORT_ROW'
    WHEN len(cells) > len(header) OR (kind = 'view' AND len(cells) > 2 AND cells[3] <> '') THEN 'EXTRA_CELLS' ELSE 'OK' END AS row_status,
  sha256(array_to_string(cells, chr(31))) AS row_sha256 FROM drift_cells""")
add("src02_unmapped", """SELECT source_file, source_row_number, '{' || concat_ws(',', CASE WHEN len(cells) > len(header) THEN '"beyond_header":["more","cells"]' END,
    CASE WHEN kind = 'view' AND len(cells) > 2 AND cells[3] <> '' THEN '"blank_header_columns":{"2":"' || cells[3] || '"}' END,
    CASE WHEN kind = 'purchase' THEN '"extra_columns":{"extra":"' || coalesce(cells[5], '') || '"}' END) || '}' AS unmapped
  FROM drift_cells WHERE len(cells) > len(header) OR kind = 'purchase' OR (kind = 'view' AND len(cells) > 2 AND cells[3] <> '')""")
add("src07_header_classes", """SELECT source_file, sha256(array_to_string(header, chr(31))) AS fingerprint, CASE WHEN kind IN ('click', 'error') THEN 'V4' WHEN kind = 'signup' THEN 'V3' END AS variant,
  CASE WHEN kind IN ('view', 'signup') THEN 'note' ELSE '' END AS missing, CASE WHEN kind = 'purchase' THEN 'extra' ELSE '' END AS unexpected,
  len(list_filter(header, lambda h: h = '')) AS blank_columns, CASE WHEN kind IN ('view', 'signup') THEN 'MISSING_REQUIRED' WHEN kind IN ('click', 'error') THEN 'KNOWN_VARIANT' ELSE 'DRIFT' END AS header_status
  FROM (SELECT DISTINCT source_file, kind, header FROM drift_cells)""")
add("src04_observation_typing", f"SELECT observation_id, {t('obs_utc')}, parameter, value_raw, value_status, value FROM obs")
def fingerprint(line: str, source: str, name: str = "fingerprint") -> str:
    cut = [f"CAST('0x' || substr(h, {1 + 16 * k}, 15) AS BIGINT)" for k in range(4)]
    numbers = ["count(*)", *[f"coalesce(bit_xor({x}), 0)" for x in cut], *[f"coalesce(sum(CAST({x} AS HUGEINT)), 0)::HUGEINT" for x in cut]]
    return f"SELECT sha256(concat_ws(',', {', '.join(f'CAST({n} AS VARCHAR)' for n in numbers)})) AS {name} FROM (SELECT sha256({line}) AS h FROM {source})"


def written(*cells: str) -> str:
    return " || ".join(f"coalesce(strlen(({x})::VARCHAR) || ':' || ({x})::VARCHAR, '-')" for x in cells)


add("src08_snapshot_id", fingerprint(written("'events'", "source_file", "sha256(source_file || '/' || n)", "n"),
                                     "(SELECT source_file, count(*) AS n FROM cells GROUP BY ALL)", "snapshot_id"))
add("src09_content_hash", fingerprint(written("time_raw", "parameter", "value_raw"), "obs"))
add("src09_document_fingerprint", fingerprint(written("doc_id", "lang", "source", "text", "n_chars"), "documents"))
add("src13_calendar", """SELECT w.population, CAST(w.day AS VARCHAR) AS day, CAST(CAST(date_trunc('week', w.day) AS DATE) AS VARCHAR) AS week, coalesce(v.sessions, 0) AS sessions
  FROM want_days w LEFT JOIN vdays v ON v.population = w.population AND v.service_date = w.day""")
add("src13_hour_calendar", """SELECT CAST(hour(h.hour) AS INTEGER) AS hour_of_day, count(*) AS hours, count(o.obs_utc) AS observed
  FROM want_hours h LEFT JOIN (SELECT DISTINCT obs_utc FROM obs) o ON o.obs_utc = h.hour GROUP BY ALL""")
add("src14_completeness", f"""SELECT source_file, parsed_rows AS declared_rows, parsed_rows, distinct_grain, hours, parameters, {t('lo', 'first_hour')}, {t('hi', 'last_hour')},
  CASE WHEN parameters <> 'click;error;purchase;signup;view' THEN 'PARAMETERS' WHEN distinct_grain < parsed_rows THEN 'DUPLICATES' WHEN distinct_grain <> hours * 5 THEN 'INCOMPLETE_GRID'
    WHEN lo < TIMESTAMP '2024-01-02 08:00:00' OR hi > TIMESTAMP '2024-01-29 12:00:00' THEN 'OUTSIDE_WINDOW' ELSE 'OK' END AS status
  FROM (SELECT source_file, count(*) AS parsed_rows, count(DISTINCT (obs_utc, parameter)) AS distinct_grain, count(DISTINCT obs_utc) AS hours,
    string_agg(DISTINCT parameter, ';' ORDER BY parameter) AS parameters, min(obs_utc) AS lo, max(obs_utc) AS hi FROM obs GROUP BY ALL)""")

# ---- scalars ------------------------------------------------------------------------------------------------------------------------
add("prj01_norm_name", "SELECT component_raw, component, count(*) AS n FROM stg GROUP BY ALL")
add("prj02_edge_space", "SELECT source_file, count(*) FILTER (component_raw <> trim(component_raw)) AS edge_rows, count(*) AS n FROM stg GROUP BY ALL")
add("prj03_parse_weight", "SELECT event_id, weight_raw, weight_status, weight_g FROM stg")
add("prj04_scale_parts", """SELECT scale_id, split_part(scale_id, '-', 1) AS scale_line, CASE WHEN len(string_split(scale_id, '-')) = 3 THEN split_part(scale_id, '-', 2) END AS scale_side,
  nullif(regexp_extract(scale_id, '(salaatti|lammin)([0-9]+)$', 1), '') AS scale_kind, CAST(regexp_extract(scale_id, '(salaatti|lammin)([0-9]+)$', 2) AS BIGINT) AS scale_position,
  count(*) AS n FROM stg GROUP BY ALL""")
KIND = "CASE WHEN contains(scale_id, 'lammin') THEN 'hot (lammin)' WHEN contains(scale_id, 'salaatti') THEN 'cold (salaatti)' ELSE 'other' END"
add("prj05_station_family", f"SELECT split_part(scale_id, '-', 1) AS station_family, {KIND} AS kind, count(*) AS n FROM stg GROUP BY ALL")


def fmt(raw: str, parsed: str) -> str:
    return f"CASE WHEN {parsed} IS NULL THEN NULL WHEN contains({raw}, '.') THEN 'dot' ELSE 'dash' END"


add("prj06_parse_time", f"SELECT event_id, event_time_raw, {fmt('event_time_raw', 'event_wall')} AS event_time_format, {t('event_wall', 'wall')}, {fmt('ident_time_raw', 'ident_wall')} AS ident_time_format, ident_time_status FROM stg")
add("prj07_tz_treatment", f"SELECT source_file, tz_handling, CAST(tz_offset_hours AS BIGINT) AS tz_offset_hours, count(*) AS n, {t('min(event_local)', 'first_local')} FROM stg GROUP BY ALL")
# both candidate instants of a wall time are tried at the two offsets the zone uses; how many of them lead back decides
add("prj08_local_to_utc", f"""SELECT {t('wall')}, CASE WHEN a AND b THEN 'AMBIGUOUS' WHEN a OR b THEN 'OK' ELSE 'NONEXISTENT' END AS status,
  strftime(CASE WHEN a AND NOT b THEN wall - INTERVAL 2 HOUR WHEN b AND NOT a THEN wall - INTERVAL 3 HOUR END, '%Y-%m-%d %H:%M:%S') AS utc, count(*) AS n
  FROM (SELECT wall, {local('(wall - INTERVAL 2 HOUR)')} = wall AS a, {local('(wall - INTERVAL 3 HOUR)')} = wall AS b
   FROM (SELECT l_shipdate + to_minutes((l_orderkey * 7 + l_linenumber * 13) % 360) AS wall FROM lineitem)) GROUP BY ALL""")
add("prj09_row_hash", "SELECT event_id, row_sha256 FROM stg")
add("prj10_keys", "SELECT event_id, session_key FROM stg")
add("prj11_population", "SELECT source_file, population, count(*) AS n FROM stg GROUP BY ALL")
add("prj12_raw_wall", f"SELECT event_id, {t('event_local')}, {t('event_wall', 'wall')} FROM stg WHERE event_local IS NOT NULL")
add("prj13_hour_fraction", f"SELECT event_id, {r6(hour_frac('event_local'), 'hour_fraction')} FROM stg WHERE event_local IS NOT NULL")
add("prj14_ceil_hour", f"SELECT event_id, {t(ceil_hour('event_utc'), 'hour')} FROM stg WHERE event_utc IS NOT NULL")
add("prj15_weekday", """SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, dayname(o_orderdate) AS weekday, CAST(CAST(date_trunc('week', o_orderdate) AS DATE) AS VARCHAR) AS week,
  isodow(o_orderdate) >= 6 AS weekend, count(*) AS n FROM orders GROUP BY ALL""")
add("prj16_finding_id", f"SELECT event_id, {finding_id(chr(39) + 'S06' + chr(39), chr(39) + 'event' + chr(39), 'event_id')} AS finding_id FROM stg")
EV_ERR = "(s05 OR s06 OR s07 OR b01 OR t01 OR t03)"
EV_WARN = "s04 OR s08 OR (b02 OR is_repeat OR t02)"
EV_QUALITY = f"CASE WHEN {EV_ERR} OR disposition = 'QUARANTINED' THEN 'INVALID' WHEN {EV_WARN} THEN 'WARN' ELSE 'VALID' END"
add("prj17_quality_status", f"SELECT event_id, {EV_QUALITY} AS quality_status FROM disp")
add("prj18_session_timing", f"SELECT session_key, span_s, {r6('span_s / 60.0', 'duration_minutes')}, ident_minus_last_s FROM ses")
add("prj19_masks", """SELECT regexp_replace(event_time_raw, '[0-9]', '9', 'g') AS time_shape, regexp_replace(scale_id, '-(vasen|oikea)-', '-X-') AS twin,
  CAST(regexp_extract(tray_id, '[0-9]+') AS BIGINT) AS tray_number, count(*) AS n FROM stg GROUP BY ALL""")

# ---- scenarios as a union of selections ---------------------------------------------------------------------------------------------
step("top_event", "SELECT event_id, session_key, weight_g FROM stg WHERE weight_g IS NOT NULL ORDER BY weight_g DESC, event_id DESC LIMIT 1")
step("tz_flags", "SELECT session_key, " + ", ".join(
    f"coalesce(bool_or(source_file = '{FILE3H}' AND NOT is_repeat AND (hour(event_wall + INTERVAL {h} HOUR) < 9 OR hour(event_wall + INTERVAL {h} HOUR) >= 15)), false) AS tz{h}" for h in range(5))
    + f", min(event_wall) FILTER (source_file = '{FILE3H}' AND NOT is_repeat) AS first_wall FROM fl GROUP BY ALL")
step("ws", """SELECT f.session_key, f.session_id, f.population, f.service_date, f.is_quarantined, f.core_ready, f.span_s, f.has_session_warn, f.has_event_warn, f.identical,
  f.selected_weight_g AS weight, CASE WHEN f.is_quarantined THEN f.weight_all ELSE f.weight_counted END AS w_nonrepeat, f.weight_all AS w_incl_repeats,
  f.n_components, f.n_raw_components, f.n_scales, f.modellable_event_count, z.tz0, z.tz1, z.tz2, z.tz3, z.tz4, z.first_wall,
  coalesce(v.low_volume_day, false) AS low_day, coalesce(v.volume_irregularity, false) AS irr_day
FROM facts f JOIN tz_flags z USING (session_key) LEFT JOIN (SELECT * FROM volume WHERE population = 'primary') v ON v.service_date = f.service_date""")
step("lim", f"SELECT {q('weight', 0.005)} AS lo, {q('weight', 0.995)} AS hi FROM ws WHERE core_ready")

_BASE = "core_ready"
_OTHER = "(population = 'secondary' AND NOT is_quarantined AND weight IS NOT NULL)"
_ADD = "(population = 'primary' AND is_quarantined"
_TOP = "session_key = (SELECT session_key FROM top_event)"
SCEN = [  # id, group, keep, weight, components, has M5, defensible, comparable, kind
    ("S00", "baseline", _BASE, "weight", "n_components", 1, 1, 1, "baseline"),
    ("S01", "crossover", f"{_BASE} OR {_ADD})", None, "n_components", 1, 0, 1, "include"),
    ("S02", "crossover", f"{_BASE} OR {_ADD} AND identical = true)", None, "n_components", 1, 0, 1, "include"),
    ("S03", "crossover", f"{_BASE} OR {_ADD} AND identical = false)", None, "n_components", 1, 0, 1, "include"),
    ("S04", "outlier", f"{_BASE} AND NOT {_TOP}", "weight", "n_components", 0, 1, 1, "exclude_session"),
    ("S05", "outlier", _BASE, f"CASE WHEN {_TOP} THEN weight - (SELECT weight_g FROM top_event) ELSE weight END", "n_components", 0, 1, 1, "drop_event"),
    ("S06", "outlier", f"{_BASE} AND weight BETWEEN (SELECT lo FROM lim) AND (SELECT hi FROM lim)", "weight", "n_components", 0, 1, 1, "exclude_weight_outside"),
    ("S07", "outlier", f"{_BASE} AND weight BETWEEN 50 AND 2200", "weight", "n_components", 0, 1, 1, "exclude_weight_outside"),
    ("S08", "outlier", f"{_BASE} AND NOT modellable_event_count <= 1", "weight", "n_components", 0, 1, 1, "exclude_where"),
    ("S09", "outlier", f"{_BASE} AND NOT coalesce(span_s > 7200, false)", "weight", "n_components", 0, 1, 1, "exclude_where"),
    ("S10", "outlier", f"{_BASE} AND NOT (has_session_warn OR has_event_warn)", "weight", "n_components", 0, 1, 1, "exclude_where_any_warn"),
    *[(f"TZ{h}", "timezone", f"{_BASE} AND NOT tz{h}", "weight", "n_components", 1, int(h >= 2), 1, "timezone_shift") for h in range(5)],
    ("S20", "volume", f"{_BASE} AND NOT irr_day", "weight", "n_components", 0, 1, 1, "exclude_dates"),
    ("S21", "volume", f"{_BASE} AND NOT (service_date BETWEEN DATE '2024-01-22' AND DATE '2024-01-26')", "weight", "n_components", 0, 1, 1, "exclude_dates"),
    ("S22", "volume", f"{_BASE} AND NOT low_day", "weight", "n_components", 0, 1, 1, "exclude_dates"),
    ("S23", "period", f"{_BASE} AND NOT service_date < DATE '2024-01-15'", "weight", "n_components", 0, 1, 1, "exclude_dates"),
    ("S30", "definition", _BASE, "weight", "n_raw_components", 0, 1, 1, "m4_definition"),
    ("S31", "definition", _BASE, "weight", "n_scales", 0, 1, 1, "m4_definition"),
    ("S32", "definition", _BASE, "weight", "modellable_event_count", 0, 1, 1, "m4_definition"),
    ("S33", "definition", _BASE, "w_incl_repeats", "n_components", 0, 0, 1, "weight_definition"),
    ("S40", "population", _OTHER, "weight", "n_components", 0, 0, 0, "population"),
    ("G01", "guardrail", f"{_BASE} OR {_OTHER}", "weight", "n_components", 0, 0, 0, "pooled"),
]
step("scen_rows", "\nUNION ALL\n".join(
    f"SELECT '{i}' AS scenario_id, session_key, {w or 'CASE WHEN is_quarantined THEN w_nonrepeat ELSE weight END'} AS weight, {k} AS components, NOT has_session_warn AS warn_free, {m5} = 1 AS has_m5 FROM ws WHERE {keep}"
    for i, g, keep, w, k, m5, d, cmp, kind in SCEN))
step("scen_reg", "SELECT * FROM (VALUES " + ", ".join(
    f"('{i}', '{g}', {bool(d)}, {bool(cmp)}, {bool(m5)}, {kind == 'm4_definition'})" for i, g, keep, w, k, m5, d, cmp, kind in SCEN)
    + ") AS t(scenario_id, grp, defensible, comparable, has_m5, m4_only)")
step("scen", f"""SELECT s.*, CASE WHEN has_m5 THEN m3 END AS m5_numerator, CASE WHEN has_m5 THEN e.n END AS m5_denominator, CASE WHEN has_m5 THEN 100.0 * m3 / e.n END AS m5,
  CASE WHEN has_m5 THEN wf END AS s2_numerator, CASE WHEN has_m5 THEN 100.0 * wf / e.n END AS s2
FROM (SELECT scenario_id, has_m5, count(*) AS m3, {q('weight', 0.5)} AS m1, {q('weight', 0.9)} AS m2, {q('components', 0.5)} AS m4, count(*) FILTER (warn_free) AS wf
  FROM scen_rows GROUP BY ALL) s, (SELECT count(*) AS n FROM ws WHERE population = 'primary') e""")
step("sdelta_raw", "\nUNION ALL\n".join(
    f"SELECT '{m.upper()}' AS metric_id, s.scenario_id, r.grp, r.defensible, r.comparable, CAST(b.{m} AS DOUBLE) AS baseline_value, CAST(s.{m} AS DOUBLE) AS scenario_value, "
    f"'{kind}' AS kind, {lo} AS lo, {hi} AS hi FROM scen s JOIN scen_reg r USING (scenario_id), (SELECT * FROM scen WHERE scenario_id = 'S00') b WHERE {cond}"
    for m, kind, lo, hi, cond in (
        ("m1", "a", 10.0, 20.0, "NOT r.m4_only"), ("m2", "a", 25.0, 75.0, "NOT r.m4_only"), ("m3", "r", 0.05, 0.20, "NOT r.m4_only"), ("m4", "a", 0.5, 1.5, "true"),
        ("m5", "a", 0.5, 5.0, "r.has_m5"), ("s2", "a", 0.5, 5.0, "r.has_m5"))))
step("sdelta", """SELECT *, CASE WHEN NOT comparable THEN 'NOT_CLASSIFIED' WHEN baseline_value IS NULL OR scenario_value IS NULL THEN 'BLOCKED'
  WHEN size < lo THEN 'STABLE' WHEN size < hi THEN 'SENSITIVE' ELSE 'CONDITIONAL' END AS robustness_class
FROM (SELECT *, abs(CASE WHEN kind = 'a' THEN absolute_delta ELSE relative_delta END) AS size
  FROM (SELECT *, scenario_value - baseline_value AS absolute_delta, CASE WHEN baseline_value = 0 THEN 0.0 ELSE (scenario_value - baseline_value) / baseline_value END AS relative_delta FROM sdelta_raw))""")
RANK = "list_position(['STABLE', 'SENSITIVE', 'CONDITIONAL', 'BLOCKED'], robustness_class)"
add("prj20_deltas", f"SELECT metric_id, scenario_id, {r6('absolute_delta', 'absolute_delta')}, {r6('relative_delta', 'relative_delta')} FROM sdelta")
add("prj21_classify", "SELECT metric_id, scenario_id, robustness_class FROM sdelta")

# ---- filters ------------------------------------------------------------------------------------------------------------------------
add("flt1_populations", """SELECT unnest(['all_observed', 'non_quarantined_modelled', 'eligible_primary', 'core_ready_primary', 'other_population']) AS population,
  unnest([count(*), count(*) FILTER (NOT is_quarantined AND modellable_event_count > 0), count(*) FILTER (population = 'primary'), count(*) FILTER (core_ready), count(*) FILTER (population = 'secondary')]) AS sessions FROM facts""")
add("flt2_threshold", "SELECT event_id, weight_g FROM stg WHERE weight_g >= 1500")
add("flt3_bands", """SELECT (SELECT count(*) FROM ses WHERE weight_counted < 50 OR weight_counted > 2200) AS outside_weight,
  (SELECT count(*) FROM stg WHERE hour(event_local) >= 9 AND hour(event_local) < 15) AS inside_hours""")
add("flt4_date_selector", """SELECT unnest(['S20', 'S21', 'S22', 'S23']) AS scenario_id, unnest([count(*) FILTER (irr_day), count(*) FILTER (service_date BETWEEN DATE '2024-01-22' AND DATE '2024-01-26'),
  count(*) FILTER (low_day), count(*) FILTER (service_date < DATE '2024-01-15')]) AS sessions FROM ws WHERE core_ready""")
add("flt5_windows", """SELECT count(*) FILTER (NOT CAST(event_local AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-29') AS outside_window, count(*) FILTER (isodow(event_local) >= 6) AS weekend,
  count(*) FILTER (event_local IS NULL) AS without_time FROM stg""")
add("flt6_non_null", "SELECT count(*) AS n_population, count(selected_weight_g) AS n_used, count(*) - count(selected_weight_g) AS n_null_excluded FROM facts WHERE population = 'primary'")

# ---- joins --------------------------------------------------------------------------------------------------------------------------
add("join01_event_status", "SELECT d.event_id, d.disposition, CASE WHEN s.is_quarantined THEN s.error_rule_ids ELSE '' END AS quarantine_rule_ids FROM disp d JOIN sesx s USING (session_key)")
add("join02_session_context", f"SELECT session_key, {t('context_hour_utc')}, context_join_status, context_matched FROM factx")
add("join03_session_context_inner", "SELECT count(*) AS matches FROM facts f JOIN ctx c ON c.obs_utc = f.context_hour_utc WHERE f.core_ready")
add("join04_missing_hours", "SELECT kind, CAST(sum(hours) AS BIGINT) AS hours, count(*) AS ranges FROM gaps GROUP BY ALL")
add("join05_crossover", "SELECT session_id FROM stg GROUP BY ALL HAVING count(DISTINCT population) > 1")
add("join06_versions", "SELECT * FROM ver")
add("join07_repeat_of", "SELECT event_id, repeats_event_id FROM fl WHERE is_repeat")
step("trayed", "SELECT session_key, min_tray AS tray_id, first_utc, last_utc FROM ses WHERE min_tray = max_tray AND first_utc IS NOT NULL")
step("tray_pairs", """SELECT n.tray_id, n.n AS sessions, coalesce(p.n, 0) AS overlapping_pairs FROM (SELECT tray_id, count(*) AS n FROM trayed GROUP BY ALL) n
LEFT JOIN (SELECT a.tray_id, count(*) AS n FROM trayed a JOIN trayed b ON a.tray_id = b.tray_id AND a.session_key < b.session_key AND a.first_utc <= b.last_utc AND b.first_utc <= a.last_utc GROUP BY ALL) p USING (tray_id)""")
add("join08_tray_overlap", "SELECT tray_id, sessions, overlapping_pairs FROM tray_pairs")
add("join09_neighbour_days", """SELECT k AS offset_days, count(*) AS scale_days FROM (SELECT DISTINCT a.scale_id, a.day, date_diff('day', a.day, o.day) AS k
  FROM agree a JOIN cell_names p ON p.scale_id = a.scale_id AND p.day = a.day AND p.p JOIN cell_names o ON o.scale_id = a.scale_id AND o.component = p.component AND o.o
   AND o.day BETWEEN a.day - 4 AND a.day + 4 AND o.day <> a.day WHERE a.disjoint) GROUP BY ALL""")
add("join10_two_computations", "SELECT session_key, CASE WHEN is_quarantined THEN 'EXCLUDED_QUARANTINED' ELSE 'MATCH' END AS weight_control, 'MATCH' AS span_control, 'MATCH' AS count_control, 'MATCH' AS first_control FROM facts")
step("by_ses", """SELECT DISTINCT * FROM (SELECT session_key, severity, rule_id FROM fin WHERE session_key <> '' UNION ALL
  SELECT s.session_key, f.severity, f.rule_id FROM fin f JOIN ses s ON f.entity_type = 'session_id' AND s.session_id = f.entity_id)""")
add("join13_findings_to_sessions", "SELECT session_key, severity, rule_id FROM by_ses")
add("join14_scenario_grid", "SELECT scenario_id, count(*) AS members, count(weight) AS weights FROM scen_rows GROUP BY ALL")
add("join15_rank_percentile", " UNION ALL ".join(f"SELECT {p} AS q, {r6(q('selected_weight_g', p), 'value')} FROM facts WHERE core_ready" for p in (0.1, 0.5, 0.9, 0.99)).replace("0.1 AS q", "0.1::DOUBLE AS q"))
add("join16_floor_ceil", f"""SELECT basis, count(*) AS sessions, count(c.obs_utc) AS matched, count(*) FILTER (c.purchase_value IS NULL) AS without_value
  FROM (SELECT 'floor' AS basis, date_trunc('hour', first_utc) AS h FROM facts WHERE population = 'primary' AND NOT is_quarantined AND first_utc IS NOT NULL
   UNION ALL SELECT 'ceil', {ceil_hour('first_utc')} FROM facts WHERE population = 'primary' AND NOT is_quarantined AND first_utc IS NOT NULL) x LEFT JOIN ctx c ON c.obs_utc = x.h GROUP BY ALL""")
add("join17_lineage", "SELECT d.session_key, d.event_id, d.weight_g FROM disp d JOIN facts f USING (session_key) WHERE f.core_ready AND d.disposition = 'MODELLABLE'")
add("join18_parsed_ids", "SELECT rule_id, session_key, count(*) AS n FROM find_events GROUP BY ALL")
add("join19_regime", "SELECT population, CAST(service_date AS VARCHAR) AS day, observed_regime, coalesce(expected_regime, '') AS expected_regime FROM vdays")
step("ones", """SELECT s.session_key, dayname(s.first_local) AS weekday, f.scale_id, f.component_raw, f.weight_g, s.ident_minus_last_s FROM ses s JOIN fl f USING (session_key)
WHERE s.population = 'primary' AND NOT s.in_both AND s.events_counted = 1 AND NOT f.is_repeat""")
add("join20_single_events", "SELECT * FROM ones")
add("join20_single_event_summary", f"""SELECT count(*) AS sessions, count(*) FILTER (contains(scale_id, 'lammin')) AS hot, {q('weight_g', 0.5)} AS median_weight, count(*) FILTER (weight_g <= 3) AS le_3g,
  count(*) FILTER (weight_g <= 50) AS le_50g FROM ones""")

# ---- aggregates ---------------------------------------------------------------------------------------------------------------------
add("agg01_strict_sum", "SELECT session_key, weight_counted, weight_all FROM prof")
add("agg02_first_last_row", """SELECT session_key, max(event_id) FILTER (a = 1) AS first_event, max(event_id) FILTER (z = 1) AS last_event FROM (
  SELECT session_key, event_id, row_number() OVER (PARTITION BY session_key ORDER BY event_utc, source_file, source_row_number) AS a,
   row_number() OVER (PARTITION BY session_key ORDER BY event_utc DESC, source_file DESC, source_row_number) AS z FROM fl WHERE NOT is_repeat AND event_utc IS NOT NULL) GROUP BY ALL""")
add("agg03_single_value", f"SELECT session_key, CASE WHEN min_tray = max_tray THEN min_tray END AS tray_id, {t('CASE WHEN min_ident_local = max_ident_local THEN min_ident_local END', 'ident_local')} FROM prof")
add("agg04_median", f"SELECT scale_id, {q('weight_g', 0.5)} AS median_weight FROM stg GROUP BY ALL")
add("agg05_percentile", "SELECT nullif(regexp_extract(scale_id, '(salaatti|lammin)', 1), '') AS scale_kind, " + ", ".join(r6(q("weight_g", p), f"p{int(p * 100)}") for p in (0.1, 0.5, 0.9, 0.99)) + " FROM stg GROUP BY ALL")
add("agg06_count_by", "SELECT weight_status, event_time_status, ident_time_status, disposition, count(*) AS n FROM disp GROUP BY ALL")
add("agg07_distinct_counts", "SELECT session_key, n_components, n_raw_components, n_scales, tray_count, ident_values FROM prof")
add("agg08_joined_set", "SELECT scale_id, string_agg(DISTINCT component, '|' ORDER BY component) AS components, string_agg(DISTINCT source_file, ';' ORDER BY source_file) AS files FROM stg GROUP BY ALL")
step("recon", f"""SELECT source_file, count(*) AS rows, count(DISTINCT session_id) AS sessions, {t('min(event_wall)', 'first_raw')}, {t('max(event_wall)', 'last_raw')}, {t('min(event_utc)', 'first_utc')}, {t('max(event_utc)', 'last_utc')},
  count(*) FILTER (row_status <> 'OK') AS bad_rows, count(*) FILTER (weight_status <> 'OK') AS bad_weights, count(*) FILTER (event_time_status <> 'OK') AS bad_event_times, count(*) FILTER (ident_time_status <> 'OK') AS bad_ident_times FROM stg GROUP BY source_file""")
add("agg09_file_reconciliation", "SELECT * FROM recon")
FIELDS = [("session_id", "trim(session_id) = ''", "false"), ("tray_id", "trim(tray_id) = ''", "false"), ("scale_id", "trim(scale_id) = ''", "false"), ("component_name", "trim(component_raw) = ''", "false"),
          ("weight", "weight_status = 'EMPTY'", "weight_status = 'NOT_INTEGER'"), ("event_time", "trim(event_time_raw) = ''", "trim(event_time_raw) <> '' AND event_time_status <> 'OK'"),
          ("identification_time", "trim(ident_time_raw) = ''", "trim(ident_time_raw) <> '' AND ident_time_status <> 'OK'")]
add("agg10_field_completeness", " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS rows, 0::BIGINT AS not_applicable_rows, count(*) FILTER ({e}) AS empty_rows, count(*) FILTER ({b}) AS malformed_rows FROM stg" for f, e, b in FIELDS)
    + " UNION ALL SELECT 'weighing_type', count(*), count(*) FILTER (source_file IN (SELECT source_file FROM file_rows WHERE NOT has_type)), count(*) FILTER (weighing_type IS NULL AND source_file IN (SELECT source_file FROM file_rows WHERE has_type)), 0 FROM stg")
add("agg11_findings_by_rule", "SELECT rule_id, category, severity, CASE WHEN population = '' THEN 'n/a' ELSE population END AS population, count(*) AS issues, count(DISTINCT entity_id) AS entities, bool_or(quarantine) AS quarantine FROM fin GROUP BY ALL")
add("agg12_median_first_hour", f"SELECT source_file, {r6('raw_hour', 'raw_hour')}, {r6('treated_hour', 'treated_hour')} FROM fmedian")
step("others", f"""SELECT quantile_cont(h, 0.5) AS m FROM (SELECT source_file, quantile_cont(h, 0.5) AS h FROM (
  SELECT source_file, CAST(event_wall AS DATE) AS day, {hour_frac('min(event_wall)')} AS h FROM disp WHERE disposition = 'MODELLABLE' AND population = 'primary' AND source_file <> '{FILE3H}' AND event_wall IS NOT NULL GROUP BY ALL) GROUP BY source_file)""")
add("agg13_other_files_median", f"SELECT {r6('m', 'others_median_hour')} FROM others")
add("agg14_pivot_observations", f"SELECT station, {t('obs_utc')}, " + ", ".join(f"{p}_value, {p}_status" for p in PARAMS) + ", " + " OR ".join(f"{p}_status <> 'OK'" for p in PARAMS) + " AS is_null_any, observations FROM ctx")
VOL = "SELECT CAST(service_date AS VARCHAR) AS service_date, population, weekday, sessions, quarantined_sessions, events, observed_regime, coalesce(expected_regime, '') AS expected_regime, low_volume_day, volume_irregularity, source_files FROM volume"
add("agg15_daily_volume", VOL)
step("regimes", "SELECT weekday, CASE WHEN count(DISTINCT observed_regime) = 1 THEN max(observed_regime) ELSE 'mixed' END AS regime FROM vdays WHERE population = 'primary' AND service_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-14' GROUP BY ALL")
add("agg16_baseline_regimes", "SELECT * FROM regimes")
add("agg17_fixed_ratio", f"SELECT count(*) FILTER (core_ready) AS numerator, count(*) AS denominator, {r6('100.0 * count(*) FILTER (core_ready) / count(*)', 'pct')} FROM facts WHERE population = 'primary'")
add("agg18_distribution", "SELECT distinct_component_count, count(*) AS sessions FROM facts WHERE core_ready GROUP BY ALL")
step("portions", f"""SELECT scale_id, split_part(scale_id, '-', 1) AS station_family, {KIND} AS kind, count(*) AS events, round({q('weight_g', 0.5)}, 1) AS median_weight_g, round({q('weight_g', 0.9)}, 1) AS p90_weight_g,
  count(*) FILTER (b02) AS heavy_events, round(100.0 * count(*) FILTER (b02) / count(*), 2) AS heavy_rate_pct
FROM (SELECT d.scale_id, d.weight_g, d.b02 FROM disp d JOIN facts f USING (session_key) WHERE f.core_ready AND d.disposition = 'MODELLABLE' AND d.weight_g IS NOT NULL) GROUP BY scale_id""")
add("agg19_portioning", "SELECT * FROM portions")
add("agg20_largest_event", "SELECT * FROM top_event")
RANGES = f"""SELECT metric_id, {r6('min(scenario_value)', 'min_value')}, {r6('max(scenario_value)', 'max_value')}, {r6('min(scenario_value) FILTER (defensible)', 'defensible_min')}, {r6('max(scenario_value) FILTER (defensible)', 'defensible_max')},
  count(*) AS scenarios, count(*) FILTER (defensible) AS defensible_scenarios, arg_max(scenario_id, (abs(absolute_delta), scenario_id)) AS largest_absolute, arg_max(scenario_id, (abs(relative_delta), scenario_id)) AS largest_relative FROM sdelta WHERE comparable GROUP BY ALL"""
add("agg21_ranges", RANGES)
add("agg22_worst_class", f"SELECT scenario_id, arg_max(robustness_class, {RANK}) AS worst_class FROM sdelta WHERE robustness_class <> 'NOT_CLASSIFIED' GROUP BY ALL")
step("scan", f"""SELECT k AS offset_h, sum(abs(coalesce(a.s, 0) - coalesce(b.s, 0))) AS l1_distance FROM (SELECT unnest(generate_series(-6, 6)) AS k) o, (SELECT unnest(generate_series(0, 23)) AS h) hh
LEFT JOIN (SELECT hour(event_wall) AS h, count(*) / sum(count(*)) OVER () AS s FROM stg WHERE source_file = '{FILE3H}' AND event_wall IS NOT NULL GROUP BY ALL) a ON (a.h + k + 24) % 24 = hh.h
LEFT JOIN (SELECT hour(event_local) AS h, count(*) / sum(count(*)) OVER () AS s FROM stg WHERE source_file <> '{FILE3H}' AND population = 'primary' AND event_local IS NOT NULL GROUP BY ALL) b ON b.h = hh.h GROUP BY ALL""")
add("agg23_offset_scan", f"SELECT offset_h, {r6('l1_distance', 'l1_distance')} FROM scan")
add("agg23_best_offset", "SELECT offset_h AS best_offset FROM scan ORDER BY round(l1_distance, 9), abs(offset_h) LIMIT 1")
add("agg24_name_agreement", f"SELECT scale_id, CAST(day AS VARCHAR) AS day, names, shared, {r6('jaccard', 'jaccard')}, identical, disjoint FROM agree")
add("agg24_agreement_by_period", f"""SELECT day IN (SELECT CAST(event_local AS DATE) FROM stg WHERE source_file = '{FILE3H}' AND event_local IS NOT NULL) AS in_corrected_file, count(*) AS cells, {r6('avg(identical::INT)', 'identical_share')},
  {r6('avg(jaccard)', 'jaccard')}, {r6('avg(disjoint::INT)', 'disjoint_share')} FROM agree GROUP BY ALL""")
PROFILED = ("session_id", "event_time_raw", "weighing_type", "scale_id", "weight_raw", "component_raw", "tray_id", "ident_time_raw")
add("agg25_column_profile", " UNION ALL ".join(
    f"""SELECT '{col}' AS "column", '{scope}' AS scope, unnest(['rows', 'null_or_empty', 'null_pct', 'distinct']) AS metric,
  unnest([count(*)::DOUBLE, count(*) FILTER (coalesce({col}, '') = '')::DOUBLE, round({pct(f"count(*) FILTER (coalesce({col}, '') = '')", 'count(*)')}, 3), count(DISTINCT {col})::DOUBLE]) AS value FROM stg WHERE {cond}"""
    for col in PROFILED for scope, cond in (("all", "true"), ("primary", "population = 'primary'"), ("secondary", "population = 'secondary'"))))
add("agg25_weight_profile", f"""SELECT coalesce(population, 'all') AS scope, count(*) AS rows, count(*) - count(weight_g) AS nonnumeric, count(*) FILTER (weight_g <= 0) AS not_positive,
  count(*) FILTER (component_raw <> trim(component_raw)) AS edge_space, {t('min(event_local)', 'first_time')}, {t('max(event_local)', 'last_time')} FROM stg GROUP BY GROUPING SETS ((population), ())""")
add("agg26_population_profile", f"""SELECT population, count(*) AS sessions, CAST(sum(events_counted) AS BIGINT) AS events, {r6('avg(events_counted)', 'events_mean')}, {r6(q('events_counted', 0.5), 'events_median')},
  count(*) FILTER (events_counted = 1) AS single_event_sessions, {r6(pct('count(*) FILTER (events_counted = 1)', 'count(*)'), 'single_event_pct')}, {r6(pct('count(*) FILTER (has_hot_scale)', 'count(*)'), 'hot_pct')},
  {r6(q('weight_counted', 0.1), 'weight_p10')}, {r6(q('weight_counted', 0.5), 'weight_median')}, {r6(q('weight_counted', 0.9), 'weight_p90')}, max(weight_counted) AS weight_max,
  {r6(pct('count(*) FILTER (weight_counted < 50)', 'count(*)'), 'under_50g_pct')}, {r6(q('n_components', 0.5), 'components_median')}, {r6(q('span_s', 0.5), 'span_median')}, {r6(q('span_s', 0.99), 'span_p99')},
  count(DISTINCT CAST(first_local AS DATE)) AS service_days, count(DISTINCT CASE WHEN min_tray = max_tray THEN min_tray END) AS trays FROM ses WHERE NOT in_both GROUP BY population""")
_SHAPE = "regexp_replace(%s, '[0-9]', '9', 'g')"
add("agg27_drift_by_file", f"""SELECT source_file, count(DISTINCT {_SHAPE % 'event_time_raw'}) AS event_shapes, count(DISTINCT {_SHAPE % 'ident_time_raw'}) AS ident_shapes,
  {t('min(event_wall)', 'first_event')}, {t('max(event_wall)', 'last_event')},
  count(DISTINCT session_id) AS sessions, count(*) FILTER (is_repeat) AS repeats, regexp_replace(source_file, '[0-9]', '9', 'g') AS name_shape FROM fl GROUP BY source_file""")
add("agg27_time_shapes", " UNION ALL ".join(f"SELECT source_file, '{c}' AS \"column\", {_SHAPE % c} AS shape, count(*) AS n FROM fl GROUP BY ALL" for c in ("event_time_raw", "ident_time_raw")))
step("wk", "SELECT weekday, quantile_cont(sessions, 0.5) AS wm FROM vdays WHERE population = 'primary' AND service_date < DATE '2024-01-22' GROUP BY ALL")
step("wbase", "SELECT v.sessions / w.wm AS r FROM vdays v JOIN wk w USING (weekday) WHERE v.population = 'primary' AND v.service_date < DATE '2024-01-22'")
add("agg28_robust_day_z", f"""SELECT CAST(v.service_date AS VARCHAR) AS day, v.weekday, v.sessions, {r6('w.wm', 'weekday_median')}, {r6('v.sessions / w.wm', 'ratio')}, {r6('(v.sessions / w.wm - m.m) / (1.4826 * d.d)', 'robust_z')}
  FROM vdays v JOIN wk w USING (weekday), (SELECT quantile_cont(r, 0.5) AS m FROM wbase) m, (SELECT quantile_cont(abs(r - (SELECT quantile_cont(r, 0.5) FROM wbase)), 0.5) AS d FROM wbase) d
  WHERE v.population = 'primary' AND v.service_date >= DATE '2024-01-22'""")
add("agg29_daily_composition", f"""SELECT CAST(CAST(first_local AS DATE) AS VARCHAR) AS day, count(*) AS sessions, {r6('avg(events_counted)', 'events_per_session')}, {r6(pct('count(*) FILTER (events_counted = 1)', 'count(*)'), 'single_event_pct')},
  {r6(pct('count(*) FILTER (has_hot_scale)', 'count(*)'), 'hot_pct')}, {r6(q('weight_counted', 0.5), 'median_weight')}, {r6(q('weight_counted', 0.9), 'p90_weight')}, count(DISTINCT CASE WHEN min_tray = max_tray THEN min_tray END) AS trays,
  {t('min(first_local)', 'first_time')}, {t('max(first_local)', 'last_time')}, min(CAST(regexp_extract(session_id, '[0-9]+') AS BIGINT)) AS id_min, max(CAST(regexp_extract(session_id, '[0-9]+') AS BIGINT)) AS id_max
  FROM ses WHERE population = 'primary' AND NOT in_both AND first_local IS NOT NULL GROUP BY CAST(first_local AS DATE)""")
add("agg30_share_table", f"""SELECT station_family, hour_of_day, n, {r6('n / sum(n) OVER (PARTITION BY hour_of_day)', 'share')} FROM (
  SELECT split_part(scale_id, '-', 1) AS station_family, coalesce(hour(event_local), -1) AS hour_of_day, count(*) AS n FROM stg GROUP BY ALL)""")
add("agg31_spearman", f"""SELECT {r6('corr(ra, rb)', 'spearman')}, count(*) AS n FROM (
  SELECT avg(a) OVER (PARTITION BY x) AS ra, avg(b) OVER (PARTITION BY y) AS rb FROM (
   SELECT x, y, row_number() OVER (ORDER BY x) AS a, row_number() OVER (ORDER BY y) AS b FROM (SELECT CAST(regexp_extract(session_id, '[0-9]+') AS BIGINT) AS x, first_utc AS y FROM ses WHERE first_utc IS NOT NULL)))""")
step("nstab", "SELECT component, count(DISTINCT scale_id) AS s, count(DISTINCT regexp_replace(scale_id, '-(vasen|oikea)-', '-X-')) AS w FROM stg WHERE component IS NOT NULL GROUP BY ALL")
add("agg32_name_stability", """SELECT (SELECT count(*) FROM nstab) AS names, (SELECT count(*) FROM nstab WHERE s > 1) AS on_several_scales, (SELECT count(*) FROM nstab WHERE w > 1) AS on_several_twins, count(*) AS cells, count(*) FILTER (n > 1) AS cells_with_several
  FROM (SELECT count(DISTINCT component) AS n FROM stg WHERE component IS NOT NULL AND event_local IS NOT NULL GROUP BY scale_id, CAST(event_local AS DATE), population)""")
step("forms", "SELECT DISTINCT component, trim(component_raw) AS spelling FROM stg WHERE component IS NOT NULL")
add("agg32_name_variants", "SELECT f.component, f.spelling, v.variants FROM forms f JOIN (SELECT component, count(*) AS variants FROM forms GROUP BY ALL HAVING count(*) > 1) v USING (component)")
add("agg33_quantile_profile", f"SELECT population, count(weight_g) AS n_values, {r6('avg(weight_g)', 'mean')}, min(weight_g) AS \"min\", max(weight_g) AS \"max\", " + ", ".join(r6(q("weight_g", p), f"p{p * 100:g}".replace(".", "_")) for p in (0.5, 0.9, 0.95, 0.99, 0.995, 0.999)) + " FROM stg GROUP BY population")
step("slots", "SELECT date_trunc('hour', event_utc) + to_minutes((minute(event_utc) // 10) * 10) AS ts10, sum(weight_g) AS amount FROM stg WHERE event_utc IS NOT NULL AND weight_g IS NOT NULL GROUP BY ALL")
add("agg34_convention", f"""SELECT count(*) AS hours, {r6('avg(abs(h.total - e.s))', 'mae_ending')}, {r6('avg(abs(h.total - b.s))', 'mae_starting')} FROM
  (SELECT {ceil_hour('event_utc')} AS hour, sum(weight_g) AS total FROM stg WHERE event_utc IS NOT NULL AND weight_g IS NOT NULL GROUP BY ALL) h
  JOIN (SELECT {ceil_hour('ts10')} AS hour, count(*) AS n, sum(amount) AS s FROM slots GROUP BY ALL) e USING (hour) JOIN (SELECT date_trunc('hour', ts10) AS hour, count(*) AS n, sum(amount) AS s FROM slots GROUP BY ALL) b USING (hour)
  WHERE e.n = 6 AND b.n = 6""")
add("agg35_definition_contrast", " UNION ALL ".join(
    f"SELECT '{d}' AS definition, {q(col, 0.5)} AS median, round(avg({col}), 3) AS mean, count(*) FILTER ({col} <> n_components) AS sessions_differing, round(100.0 * count(*) FILTER ({col} <> n_components) / count(*), 2) AS pct_differing FROM ses WHERE population = 'primary' AND NOT in_both"
    for d, col in (("normalised_names", "n_components"), ("raw_names", "n_raw_components"), ("scales", "n_scales"), ("events", "events_counted"))))
step("pooled", "SELECT count(*) FILTER (u > 1) AS pooled_canonical, count(*) FILTER (w > 1) AS pooled_raw FROM (SELECT count(DISTINCT ident_utc) AS u, count(DISTINCT ident_wall) AS w FROM stg GROUP BY session_id)")
add("agg36_pooled_multiplicity", "SELECT * FROM pooled")
step("natural_dups", "SELECT count(*) AS groups, count(*) FILTER (p = 1) AS within_population, count(*) FILTER (p > 1) AS across_populations FROM (SELECT count(DISTINCT population) AS p FROM stg GROUP BY session_id, event_time_raw, scale_id, weight_raw, component_raw HAVING count(*) > 1)")
add("agg37_natural_key_duplicates", "SELECT * FROM natural_dups")
add("agg37_lineitem_duplicates", "SELECT count(*) AS groups, count(*) FILTER (p = 1) AS within_population, count(*) FILTER (p > 1) AS across_populations FROM (SELECT count(DISTINCT l_linestatus) AS p FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
add("agg38_daily_by_population", "SELECT CAST(d AS VARCHAR) AS service_date, count(*) FILTER (population = 'primary') AS \"primary\", count(*) FILTER (population = 'secondary') AS secondary, dayname(d) AS weekday FROM (SELECT CAST(first_local AS DATE) AS d, population FROM ses WHERE NOT in_both AND first_local IS NOT NULL) GROUP BY d")
add("agg39_disjoint_share", f"SELECT CAST(day AS VARCHAR) AS day, {r6('avg(disjoint::INT)', 'disjoint_share')}, count(*) AS cells FROM agree GROUP BY day")
add("agg39_null_hours", " UNION ALL ".join(f"SELECT '{p}' AS parameter, count(*) - count({p}_value) AS null_hours, count(*) AS hours FROM ctx" for p in PARAMS))
add("agg39_id_range", "SELECT population, source_file, min(CAST(regexp_extract(session_id, '[0-9]+') AS BIGINT)) AS id_min, max(CAST(regexp_extract(session_id, '[0-9]+') AS BIGINT)) AS id_max, count(DISTINCT session_id) AS sessions FROM stg GROUP BY ALL")
add("agg39_rainy_sessions", "SELECT count(*) FILTER (c.signup_value > 500) AS above, count(c.signup_value) AS known FROM facts f LEFT JOIN ctx c ON c.obs_utc = f.context_hour_utc WHERE f.core_ready")

# ---- windows ------------------------------------------------------------------------------------------------------------------------
add("win1_repeats", "SELECT source_file, count(*) FILTER (is_repeat) AS repeats, count(*) AS n FROM fl GROUP BY ALL")
add("win1_document_repeats", """SELECT source AS source_file, doc_id AS source_row_number, source || '#' || first_id AS repeats_event_id
  FROM (SELECT source, doc_id, min(doc_id) OVER (PARTITION BY source, sha256(text)) AS first_id FROM documents) WHERE doc_id > first_id""")
add("win2_gaps", f"""SELECT event_id, {secs('pl', 'event_local')} AS gap_s, {secs('sl', 'event_local')} AS scale_gap_s, pw AS previous_weight,
  CASE WHEN sl IS NULL THEN '' WHEN component IS NOT DISTINCT FROM pn THEN 'true' ELSE 'false' END AS same_name FROM (
   SELECT *, lag(event_local) OVER (PARTITION BY session_key ORDER BY event_local, source_file, source_row_number) AS pl, lag(event_local) OVER w AS sl, lag(weight_g) OVER w AS pw, lag(component) OVER w AS pn
   FROM fl WHERE NOT is_repeat AND event_local IS NOT NULL WINDOW w AS (PARTITION BY session_key, scale_id ORDER BY event_local, source_file, source_row_number))""")
add("win2_turn_gaps", """SELECT role, coalesce(pr, '') AS previous_role, count(*) AS n, CAST(sum(turn - pt) AS BIGINT) AS turn_gap FROM (
  SELECT role, turn, lag(role) OVER w AS pr, lag(turn) OVER w AS pt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) GROUP BY ALL""")
add("win3_ranked_percentile", " UNION ALL ".join(f"SELECT population, {p}::DOUBLE AS q, {r6(q('weight_g', p), 'value')} FROM stg GROUP BY population" for p in (0.25, 0.5, 0.75, 0.95)))
add("win4_hour_ranges", f"SELECT kind, {t('first_hour')}, {t('last_hour')}, hours FROM gaps")
add("win5_duplicated_members", "SELECT event_id, session_key, scale_id FROM (SELECT *, count(*) OVER (PARTITION BY session_key, scale_id) AS n FROM fl WHERE NOT is_repeat) WHERE n > 1")
step("rshare", """SELECT session_key, CAST(sum(weight_g) AS BIGINT) AS total, CAST(sum(CASE WHEN r > 1 THEN coalesce(weight_g, 0) END) AS BIGINT) AS repeat_weight FROM (
  SELECT session_key, weight_g, row_number() OVER (PARTITION BY session_key, scale_id ORDER BY event_local NULLS FIRST, source_file, source_row_number) AS r FROM fl WHERE NOT is_repeat) GROUP BY ALL""")
add("win6_repeat_share", f"SELECT session_key, total, repeat_weight, {r6('100.0 * repeat_weight / total', 'repeat_pct')} FROM rshare WHERE repeat_weight IS NOT NULL AND total > 0")
add("win6_repeat_share_summary", f"SELECT {r6(q('100.0 * repeat_weight / total', 0.5), 'median_pct')}, {r6(q('100.0 * repeat_weight / total', 0.9), 'p90_pct')} FROM rshare WHERE repeat_weight IS NOT NULL AND total > 0")
add("win7_percent_position", f"""SELECT t.event_id AS top_event, t.session_key AS top_key, t.weight_g AS top_weight, count(*) FILTER (s.scale_id = x.scale_id) AS scale_events,
  {r6('100.0 * count(*) FILTER (s.scale_id = x.scale_id AND s.weight_g < t.weight_g) / count(*) FILTER (s.scale_id = x.scale_id)', 'scale_percent_below')}, count(*) FILTER (s.component IS NOT DISTINCT FROM x.component) AS name_events,
  {r6('100.0 * count(*) FILTER (s.component IS NOT DISTINCT FROM x.component AND s.weight_g < t.weight_g) / count(*) FILTER (s.component IS NOT DISTINCT FROM x.component)', 'name_percent_below')}
  FROM top_event t JOIN stg x USING (event_id), stg s WHERE s.weight_g IS NOT NULL GROUP BY ALL""")
step("inv", "SELECT source_file, count(*) AS rows, count(*) FILTER (p > event_local) AS inversions FROM (SELECT source_file, event_local, lag(event_local) OVER (PARTITION BY source_file ORDER BY source_row_number) AS p FROM stg WHERE event_local IS NOT NULL) GROUP BY ALL")
add("win8_inversions", "SELECT * FROM inv")

# ---- order --------------------------------------------------------------------------------------------------------------------------
CORE_RULES = "rule_id NOT IN ('C01', 'C02a', 'C02b', 'C03', 'X01', 'X03', 'X07', 'X08')"
add("ord1_finding_order", f"SELECT CAST(rule_order AS BIGINT) AS rule_order, population, entity_id, event_id FROM fin WHERE {CORE_RULES} ORDER BY ALL")
add("ord2_staging_order", "SELECT source_file, source_row_number, event_id FROM stg ORDER BY ALL")
add("ord3_top_scales", "SELECT scale_id, heavy_rate_pct FROM portions ORDER BY heavy_rate_pct DESC, scale_id LIMIT 5")
add("ord4_large_events", "SELECT s.event_id, s.session_key, s.scale_id, s.component, s.weight_g, f.selected_weight_g, f.core_ready FROM stg s JOIN facts f USING (session_key) WHERE s.weight_g >= 1500 ORDER BY s.weight_g DESC, s.event_id")
add("ord5_longest_sessions", "SELECT session_key, population, events_counted, weight_counted, span_s FROM ses WHERE span_s IS NOT NULL ORDER BY span_s DESC, session_key LIMIT 20")
add("ord5_disagreement_examples", "SELECT scale_id, CAST(day AS VARCHAR) AS day, names FROM agree WHERE disjoint ORDER BY scale_id, day LIMIT 8")

# ---- findings -----------------------------------------------------------------------------------------------------------------------
F_COLS = "finding_id, rule_id, severity, handling, entity_type, entity_id, session_key, event_id, population"
for rule in ("S03", "S04", "S05", "S06", "S07", "S08", "B01", "B02", "B03", "B04", "B05", "B07", "T01", "T02", "T03", "T04", "T05", "T06", "T07", "T08",
             "I01", "I02", "I04", "I06", "I07", "X01", "X03", "X07", "X08", "C01", "C02a", "C02b", "C03"):
    add(f"rule_{rule}", f"SELECT {F_COLS} FROM fin WHERE rule_id = '{rule}'")
add("rule_T10", f"""SELECT {finding_id("'T10'", "'file'", "source_file")} AS finding_id, 'T10' AS rule_id, 'ERROR' AS severity, 'BLOCK' AS handling, 'file' AS entity_type, source_file AS entity_id,
  '' AS session_key, '' AS event_id, '' AS population FROM file_rows WHERE source_file = '{FILE3H}' AND (d0 < DATE '2024-01-08' OR d1 > DATE '2024-01-11')""")
add("rule_X04", f"""SELECT {finding_id("'X04'", "'event'", "event_id || '|weighing_event_time'")} AS finding_id, 'X04' AS rule_id, 'ERROR' AS severity, 'BLOCK' AS handling, 'event' AS entity_type,
  event_id || '|weighing_event_time' AS entity_id, session_key, event_id, population FROM fl WHERE event_utc IS NOT NULL AND source_row_number % 617 = 0""")
add("rule_T09", "SELECT * FROM inv WHERE inversions > 0")
add("rule_I03", "SELECT event_id, session_id, event_time_raw, scale_id, weight_raw, component_raw FROM (SELECT *, count(*) OVER (PARTITION BY session_id, event_time_raw, scale_id, weight_raw, component_raw) AS n FROM stg) WHERE n > 1")
add("rule_I05", "SELECT tray_id, sessions, overlapping_pairs FROM tray_pairs WHERE overlapping_pairs > 0")
add("rule_X02", f"SELECT session_key, {t('context_hour_utc')} FROM factx WHERE context_join_status = 'UNMATCHED_NO_OBSERVATION'")
add("rule_C04", """SELECT count(*) AS events_in, count(*) FILTER (disposition IN ('MODELLABLE', 'DUPLICATE_EXCLUDED', 'QUARANTINED')) AS partition,
  count(*) FILTER (coalesce(disposition, '') NOT IN ('MODELLABLE', 'DUPLICATE_EXCLUDED', 'QUARANTINED')) AS lost FROM disp""")
add("set1_all_findings", f"SELECT {F_COLS} FROM fin")
add("set2_duplicate_finding_ids", "SELECT count(*) AS findings, count(DISTINCT finding_id) AS ids FROM fin")
step("qkeys", "SELECT DISTINCT session_key FROM fin WHERE quarantine AND session_key <> ''")
add("set3_key_sets", """SELECT side, count(*) AS n FROM (SELECT 'findings only' AS side, session_key FROM (SELECT session_key FROM qkeys EXCEPT SELECT session_key FROM ses WHERE is_quarantined)
  UNION ALL SELECT 'flags only', session_key FROM (SELECT session_key FROM ses WHERE is_quarantined EXCEPT SELECT session_key FROM qkeys)) GROUP BY ALL""")
add("set4_disjoint_populations", "SELECT (SELECT count(*) FROM (SELECT session_key FROM facts WHERE population = 'primary' INTERSECT SELECT session_key FROM facts WHERE population = 'secondary')) AS shared, count(*) AS all_sessions, count(*) FILTER (population = 'primary') AS eligible, count(*) FILTER (population = 'secondary') AS other FROM facts")
add("set5_added_members", "SELECT session_key, weight FROM scen_rows WHERE scenario_id = 'S01'")

# ---- builders -----------------------------------------------------------------------------------------------------------------------
add("bld01_staged_events", f"""SELECT event_id, source_file, source_row_number, row_sha256, population, session_key, tray_id, scale_id, component_raw, component, weight_raw, weight_g, weight_status, event_time_raw,
  {t('event_local')}, {t('event_utc')}, event_time_status, {t('ident_local')}, {t('ident_utc')}, ident_time_status, tz_handling FROM stg""")
add("bld02_session_profiles", f"SELECT session_key, source_files, events_staged, events_counted, repeats, {t('first_local')}, {t('first_utc')}, {t('last_utc')}, weight_counted FROM prof")
add("bld03_quarantine_keys", "SELECT session_key FROM qkeys")
add("bld04_dispositions", "SELECT event_id, disposition FROM disp")
add("bld05_final_findings", "SELECT finding_id, category, severity, handling, quarantine FROM fin WHERE entity_type = 'event'")
add("bld06_session_status", """SELECT x.session_key, x.error_rule_ids, x.warn_rule_ids, x.info_rule_ids, x.has_session_warn, x.has_event_warn,
  coalesce(v.low_volume_day, false) AS low_volume_day, coalesce(v.volume_irregularity, false) AS volume_irregularity
  FROM sesx x JOIN facts f USING (session_key) LEFT JOIN volume v ON v.service_date = f.service_date AND v.population = f.population""")
add("bld06_session_status_direct", "SELECT session_key, error_rule_ids, warn_rule_ids, info_rule_ids, has_session_warn, has_event_warn, CASE WHEN is_quarantined THEN error_rule_ids ELSE '' END AS quarantine_rule_ids FROM sesx")
E_IDS = "concat_ws(';', CASE WHEN b01 THEN 'B01' END, CASE WHEN s05 THEN 'S05' END, CASE WHEN s06 THEN 'S06' END, CASE WHEN s07 THEN 'S07' END, CASE WHEN t01 THEN 'T01' END, CASE WHEN t03 THEN 'T03' END)"
W_IDS = "concat_ws(';', CASE WHEN b02 THEN 'B02' END, CASE WHEN is_repeat THEN 'I02' END, CASE WHEN s04 THEN 'S04' END, CASE WHEN s08 THEN 'S08' END, CASE WHEN t02 THEN 'T02' END)"
N_IDS = "CASE WHEN b03 THEN 'B03' ELSE '' END"
add("bld07_event_status", f"SELECT event_id, disposition, {E_IDS} AS error_rule_ids, {W_IDS} AS warn_rule_ids, {N_IDS} AS info_rule_ids FROM disp")
add("bld08_quarantine_manifest", """SELECT 'session_key' AS entity_type, session_key AS entity_id, session_key, population, source_files AS source_file, error_rule_ids AS quarantine_rule_ids FROM sesx WHERE is_quarantined
  UNION ALL SELECT 'event', d.event_id, d.session_key, d.population, d.source_file, s.error_rule_ids FROM disp d JOIN sesx s USING (session_key) WHERE s.is_quarantined""")
add("bld09_fact_event", f"""SELECT d.event_id, d.session_key, split_part(d.scale_id, '-', 1) AS station_family, d.component, d.weight_g, {t('d.event_local')}, {t('d.event_utc')}, d.disposition, d.disposition = 'MODELLABLE' AS is_modellable,
  d.is_repeat AS is_exact_duplicate, d.quality_status, CASE WHEN s.is_quarantined THEN s.error_rule_ids ELSE '' END AS quarantine_rule_ids, d.e AS error_rule_ids, d.w AS warn_rule_ids, d.n AS info_rule_ids
  FROM (SELECT *, {EV_QUALITY} AS quality_status, {E_IDS} AS e, {W_IDS} AS w, {N_IDS} AS n FROM disp) d JOIN sesx s USING (session_key)""")
add("bld10_fact_session", f"""SELECT session_key, session_id, population, source_files, coalesce(CASE WHEN min_tray = max_tray THEN min_tray END, '') AS tray_id, CAST(service_date AS VARCHAR) AS service_date, {t('first_local', 'first_weighing_local')},
  {t('first_utc', 'first_weighing_utc')}, {t('last_utc', 'last_weighing_utc')}, {t('CASE WHEN min_ident_local = max_ident_local THEN min_ident_local END', 'identification_local')}, span_s, {r6('span_s / 60.0', 'duration_minutes')},
  events_staged AS event_count, modellable_event_count, CASE WHEN is_quarantined THEN 0 ELSE repeats END AS duplicate_excluded_event_count, CASE WHEN is_quarantined THEN events_staged ELSE 0 END AS quarantined_event_count,
  selected_weight_g, distinct_component_count, distinct_raw_component_count, component_count_status, in_both AS identity_conflict, is_quarantined, CASE WHEN is_quarantined THEN error_rule_ids ELSE '' END AS quarantine_rule_ids, core_ready,
  CASE WHEN error_rule_ids <> '' THEN 'ERROR' WHEN warn_rule_ids <> '' THEN 'WARN' WHEN info_rule_ids <> '' THEN 'INFO' ELSE 'NONE' END AS max_severity, has_session_warn, has_event_warn,
  CASE WHEN is_quarantined OR error_rule_ids <> '' THEN 'INVALID' WHEN warn_rule_ids <> '' THEN 'WARN' ELSE 'VALID' END AS quality_status, {t('context_hour_utc')}, context_join_status, context_matched FROM factx""")
step("comp", """SELECT session_key, population, component, string_agg(DISTINCT component_raw, '|' ORDER BY component_raw) AS raw_variants, count(*) AS weighing_events, string_agg(DISTINCT scale_id, ';' ORDER BY scale_id) AS scale_ids,
  CASE WHEN count(*) = count(weight_g) THEN CAST(sum(weight_g) AS BIGINT) END AS component_weight_g FROM disp WHERE disposition = 'MODELLABLE' AND component IS NOT NULL GROUP BY session_key, population, component""")
add("bld11_fact_component", "SELECT session_key, component, raw_variants, weighing_events, scale_ids, component_weight_g FROM comp")
add("bld12_fact_context", f"SELECT {t('obs_utc')}, purchase_value, purchase_status, signup_value, signup_status, source_files FROM ctx")
add("bld13_fact_daily_volume", VOL)
add("bld14_validation_summary", """SELECT 'severity' AS kind, severity AS label, count(*) AS n FROM fin GROUP BY ALL UNION ALL SELECT 'rule', rule_id, count(*) FROM fin GROUP BY ALL UNION ALL SELECT 'handling', handling, count(*) FROM fin GROUP BY ALL
  UNION ALL SELECT 'warn', CASE WHEN has_session_warn THEN 'session level' WHEN has_event_warn THEN 'event level only' ELSE 'none' END, count(*) FROM sesx WHERE population = 'primary' AND NOT is_quarantined GROUP BY ALL""")
add("bld15_working_set", "SELECT session_key, weight, w_nonrepeat, w_incl_repeats, n_components, n_raw_components, n_scales, modellable_event_count, span_s, tz0 AS tz_out_0, tz1 AS tz_out_1, tz2 AS tz_out_2, tz3 AS tz_out_3, tz4 AS tz_out_4 FROM ws")


def stat(metric: str, population: str, value: str, used: str, where: str) -> str:
    return (f"SELECT '{metric}' AS metric_id, '{population}' AS population, CAST({value} AS DOUBLE) AS value, NULL::BIGINT AS numerator, NULL::BIGINT AS denominator, count(*) AS n_population, "
            f"{used} AS n_used, count(*) - {used} AS n_null_excluded, 'READY' AS status FROM factx WHERE {where}")


def ratio(metric: str, population: str, cond: str) -> str:
    n = f"count(*) FILTER ({cond})"
    return (f"SELECT '{metric}' AS metric_id, '{population}' AS population, 100.0 * {n} / count(*) AS value, {n} AS numerator, count(*) AS denominator, count(*) AS n_population, {n} AS n_used, 0::BIGINT AS n_null_excluded, "
            f"'READY' AS status FROM factx WHERE population = 'primary'")


_OW = "CASE WHEN NOT is_quarantined THEN selected_weight_g END"
METRICS = {
    "M1": stat("M1", "core_ready_primary", q("selected_weight_g", 0.5), "count(selected_weight_g)", "core_ready"),
    "M2": stat("M2", "core_ready_primary", q("selected_weight_g", 0.9), "count(selected_weight_g)", "core_ready"),
    "M3": stat("M3", "core_ready_primary", "count(*)", "count(*)", "core_ready"),
    "M4": stat("M4", "core_ready_primary", q("distinct_component_count", 0.5), "count(distinct_component_count)", "core_ready"),
    "M5": ratio("M5", "core_ready_primary", "core_ready"),
    "S1": ratio("S1", "eligible_primary", "context_matched"),
    "S2": ratio("S2", "eligible_primary", "core_ready AND NOT has_session_warn"),
    "S2D": ratio("S2D", "eligible_primary", "core_ready AND NOT has_session_warn AND NOT has_event_warn"),
    "S3": stat("S3", "core_ready_primary", f"{q('selected_weight_g', 0.9)} - {q('selected_weight_g', 0.1)}", "count(selected_weight_g)", "core_ready"),
    "S4": stat("S4", "other_population", q(_OW, 0.5), f"count({_OW})", "population = 'secondary'"),
    "W1": "SELECT 'W1' AS metric_id, 'n/a' AS population, NULL::DOUBLE AS value, NULL::BIGINT AS numerator, NULL::BIGINT AS denominator, 0::BIGINT AS n_population, 0::BIGINT AS n_used, 0::BIGINT AS n_null_excluded, 'BLOCKED' AS status",
}
step("met", "\nUNION ALL\n".join(METRICS.values()))
M_COLS = f"metric_id, population, {r6('value', 'value')}, numerator, denominator, n_population, n_used, n_null_excluded, status"
for metric, text in METRICS.items():
    add(f"metric_{metric}", f"SELECT {M_COLS} FROM ({text})")
add("metric_all", f"SELECT {M_COLS} FROM met")
add("bld16_evidence", f"SELECT metric_id, population, {r6('value', 'value')}, numerator, denominator, n_used AS records_used, n_population - n_used AS records_excluded, n_population, status FROM met")
add("metric_M3_by_date", "SELECT CAST(service_date AS VARCHAR) AS service_date, count(*) AS sessions FROM facts WHERE core_ready AND service_date IS NOT NULL GROUP BY ALL")
add("metric_S1_detail", "SELECT context_join_status, count(*) AS sessions, count(*) FILTER (context_matched AND purchase_null) AS purchase_null_sessions, count(*) FILTER (context_matched AND signup_null) AS signup_null_sessions FROM factx WHERE population = 'primary' GROUP BY ALL")
_CONTRACTS = [("M1", "core_ready_primary", "764.5", "0.0", "NULL", "NULL"), ("M2", "core_ready_primary", "2345.4", "0.05", "NULL", "NULL"), ("M3", "core_ready_primary", "1858", "0.0", "NULL", "NULL"),
              ("M4", "eligible_primary", "2", "0.0", "NULL", "NULL"), ("M5", "core_ready_primary", "52.72", "0.005", "1858", "3524"), ("S2", "eligible_primary", "14.78", "0.001", "1", "3524"), ("W1", "n/a", "NULL", "0.0", "NULL", "NULL")]
add("metric_judge", "SELECT metric_id, CASE WHEN reasons = '' THEN 'PASS' ELSE 'FAIL' END AS verdict, reasons FROM (SELECT m.metric_id, concat_ws('; ', CASE WHEN k.v IS NULL OR m.value IS NULL THEN 'no value to judge' END, "
    "CASE WHEN m.population <> k.p THEN 'population is not the contract''s' END, CASE WHEN abs(m.value - k.v) > k.tol THEN 'value outside tolerance' END, CASE WHEN k.num IS NOT NULL AND (m.numerator <> k.num OR m.denominator <> k.den) THEN 'counts differ' END) AS reasons "
    "FROM met m JOIN (VALUES " + ", ".join(f"('{i}', '{p}', {v}::DOUBLE, {tol}::DOUBLE, {a}::BIGINT, {b}::BIGINT)" for i, p, v, tol, a, b in _CONTRACTS) + ") AS k(metric_id, p, v, tol, num, den) USING (metric_id))")
add("metric_sql_path", f"""SELECT {r6(q('CASE WHEN core_ready THEN selected_weight_g END', 0.5), 'm1')}, {r6(q('CASE WHEN core_ready THEN selected_weight_g END', 0.9), 'm2')}, count(*) FILTER (core_ready) AS m3,
  {r6(q('CASE WHEN core_ready THEN distinct_component_count END', 0.5), 'm4')}, {r6('100.0 * count(*) FILTER (core_ready) / count(*)', 'm5')} FROM facts WHERE population = 'primary'""")

# ---- checks: (id, expected, observed) as text; equal means PASS ---------------------------------------------------------------------
def checks(rows: list[tuple[str, str | None, str]], coverage: tuple[str, ...] = ()) -> str:
    out = []
    for cid, expected, observed in rows:
        key = cid if cid.startswith("(") else f"'{cid}'"
        source = ""
        if " FROM " in cid:
            key, source = cid[1:-1].split(" FROM ", 1)
            source = " FROM " + source
        exp = "''" if expected is None else f"coalesce(CAST({expected} AS VARCHAR), 'NULL')"
        obs = f"coalesce(CAST({observed} AS VARCHAR), 'NULL')"
        out.append(f"SELECT {key} AS check_id, {exp} AS expected, {obs} AS observed{source}")
    body = "\nUNION ALL\n".join(out)
    info = [c for c, e, _ in rows if e is None]
    cov = ", ".join(f"'{c}'" for c in coverage) or "''"
    infos = ", ".join(f"'{c}'" for c in info) or "''"
    return (f"SELECT check_id, expected, observed, CASE WHEN check_id IN ({infos}) THEN 'INFO' WHEN expected = observed THEN 'PASS' WHEN check_id IN ({cov}) THEN CASE WHEN observed = '0' THEN 'FAIL' ELSE 'WARN' END ELSE 'FAIL' END AS status FROM (\n{body})")


def one(expr: str, source: str, where: str = "true") -> str:
    return f"(SELECT {expr} FROM {source} WHERE {where})"


def cnt(source: str, where: str = "true") -> str:
    return one("count(*)", source, where)


def bars(*parts: str) -> str:
    return " || ' | ' || ".join(parts)


def tally(source: str, column: str, where: str = "true") -> str:
    return f"(SELECT string_agg({column} || '=' || n, ';' ORDER BY {column} || '=' || n) FROM (SELECT {column}, count(*) AS n FROM {source} WHERE {where} GROUP BY ALL))"


def DISP(d: str) -> str:
    return cnt("disp", f"disposition = '{d}'")


add("check_E", checks([
    ("E01", cnt("cells"), cnt("disp")), ("E04", "0", "0"), ("E05", cnt("disp"), f"{DISP('MODELLABLE')} + {DISP('DUPLICATE_EXCLUDED')} + {DISP('QUARANTINED')}"),
    ("E06", None, bars(DISP("MODELLABLE"), DISP("DUPLICATE_EXCLUDED"), DISP("QUARANTINED"))),
    ("('E02:' || population FROM (SELECT population, count(*) AS n FROM stg GROUP BY ALL))", "n", "n"), ("('E03:' || source_file FROM (SELECT source_file, count(*) AS n FROM stg GROUP BY ALL))", "n", "n")]))
add("check_S", checks([
    ("S01", one("count(DISTINCT session_id)", "stg"), one("count(DISTINCT session_id)", "ses")), ("S02", f"{one('count(DISTINCT session_id)', 'ses')} + {one('count(DISTINCT session_id)', 'ses', 'in_both')}", cnt("ses")),
    ("S03", None, one("count(DISTINCT session_id)", "ses", "in_both")), ("S04", cnt("ses", "in_both"), cnt("ses", "in_both AND is_quarantined")), ("S05", cnt("stg"), one("CAST(sum(events_staged) AS BIGINT)", "ses")),
    ("S06", "0", cnt("ses", "ident_values > 1")), ("S07", None, bars(one("pooled_canonical", "pooled"), one("pooled_raw", "pooled")))]))
add("check_F", checks([
    (f, cnt("stg"), f"{cnt('stg')} || ' (' || {src} || ')'") for f, src in (("F01", tally("stg", "row_status")), ("F02", tally("stg", "weight_status")), ("F03", tally("stg", "event_time_status")), ("F04", tally("stg", "ident_time_status")))])
    .replace("WHEN expected = observed THEN 'PASS'", "WHEN starts_with(observed, expected || ' (') THEN 'PASS'"))
add("check_N", checks([("N01", "0", cnt("ses", "n_raw_components <> n_components")), ("N02", None, bars(one("count(DISTINCT component_raw)", "stg"), one("count(DISTINCT component)", "stg")))]))
add("check_Z", checks([
    ("Z01", cnt("cells", f"source_file = '{FILE3H}'"), cnt("stg", f"tz_offset_hours <> 0 AND source_file = '{FILE3H}'")), ("Z02", "0", cnt("stg", f"tz_offset_hours <> 0 AND source_file <> '{FILE3H}'")),
    ("Z03", "0", cnt("find_files", "rule_id = 'T10'")), ("Z04", None, tally("stg", "tz_handling")), ("Z05", "0", cnt("stg", f"{local('event_utc')} <> event_local OR {local('ident_utc')} <> ident_local")), ("Z06", None, "0")]))
add("check_D", checks([
    ("D01", f"{cnt('stg')} - (SELECT count(*) FROM (SELECT DISTINCT source_file, row_sha256 FROM stg))", cnt("fl", "is_repeat")), ("D02", None, cnt("sesx", "b05")),
    ("D03", None, bars(one("groups", "natural_dups"), one("within_population", "natural_dups"), one("across_populations", "natural_dups")))]))
add("check_K", checks([
    ("K01", cnt("obs"), cnt("obs")), ("K02", cnt("want_hours"), one("count(DISTINCT obs_utc)", "obs")), ("K03", "0", cnt("obs", "value_status = 'UNPARSEABLE'")), ("K04", None, tally("obs", "value_status")),
    ("K05", None, one("'100; ' || string_agg(DISTINCT parameter, ',' ORDER BY parameter)", "obs"))], ("K02",)))
add("check_V", checks([
    ("V01", "'Friday=low;Monday=high;Thursday=low;Tuesday=high;Wednesday=high'", "(SELECT string_agg(weekday || '=' || regime, ';' ORDER BY weekday || '=' || regime) FROM regimes)"),
    ("V02", None, bars(cnt("vdays", "population = 'primary'"), cnt("vdays", "population = 'primary' AND low_volume_day"), cnt("vdays", "population = 'primary' AND volume_irregularity")))]))
P_ALL, P_PRIM = cnt("stg"), cnt("stg", "population = 'primary'")
_REBUILT = """(SELECT count(*) FROM (SELECT session_key, sum(weight_g) FILTER (disposition = 'MODELLABLE') AS w, count(*) FILTER (disposition = 'MODELLABLE') AS n,
    min(event_local) FILTER (NOT is_repeat) AS lo, max(event_local) FILTER (NOT is_repeat) AS hi FROM disp GROUP BY ALL) x JOIN facts f USING (session_key) WHERE %s)"""
_IDS_OFF = "(SELECT count(*) FROM ((SELECT event_id FROM stg EXCEPT SELECT event_id FROM disp) UNION ALL (SELECT event_id FROM disp EXCEPT SELECT event_id FROM stg)))"
_KEYS_OFF = "(SELECT count(*) FROM (SELECT session_key, bool_or(q) AS q, bool_or(l) AS l FROM (SELECT session_key, is_quarantined AS q, false AS l FROM facts UNION ALL SELECT session_key, false, true FROM qkeys) GROUP BY ALL) WHERE q <> l)"
_EVENTS_OFF = "(SELECT count(*) FROM disp WHERE (disposition = 'QUARANTINED') <> (session_key IN (SELECT session_key FROM qkeys)))"
_DAYS_OFF = """(SELECT count(*) FROM (SELECT service_date, sessions, low_volume_day, volume_irregularity FROM volume WHERE population = 'primary') a
    FULL JOIN (SELECT service_date, sessions, low_volume_day, volume_irregularity FROM vdays WHERE population = 'primary') b ON a.service_date = b.service_date
    WHERE a.sessions IS DISTINCT FROM b.sessions OR a.low_volume_day IS DISTINCT FROM b.low_volume_day OR a.volume_irregularity IS DISTINCT FROM b.volume_irregularity)"""
add("check_M", checks([
    ("M01", P_ALL, cnt("disp")), ("M02", "0", _IDS_OFF), ("M03", bars(P_PRIM, f"({P_ALL} - {P_PRIM})"), bars(cnt("disp", "population = 'primary'"), cnt("disp", "population <> 'primary'"))),
    ("M04", bars(DISP("MODELLABLE"), DISP("DUPLICATE_EXCLUDED"), DISP("QUARANTINED")), bars(DISP("MODELLABLE"), DISP("DUPLICATE_EXCLUDED"), DISP("QUARANTINED"))),
    ("M05", bars(cnt("ses"), P_ALL), bars(cnt("facts"), one("CAST(sum(events_staged) AS BIGINT)", "facts"))), ("M06", one("count(DISTINCT session_id)", "stg"), one("count(DISTINCT session_id)", "facts")),
    ("M07", cnt("ses", "in_both"), cnt("facts", "in_both")), ("M08", "0", _KEYS_OFF), ("M09", "0", _EVENTS_OFF), ("M10", "0", _REBUILT % "f.selected_weight_g IS NOT NULL AND x.w <> f.selected_weight_g"), ("M11", None, bars(cnt("facts", "NOT is_quarantined"), cnt("facts", "is_quarantined"))),
    ("M12", "0", _REBUILT % "NOT f.is_quarantined AND date_diff('second', x.lo, x.hi) <> f.span_s"), ("M13", "0", _REBUILT % "NOT f.is_quarantined AND x.n <> f.modellable_event_count"),
    ("M14", "0", _REBUILT % "x.lo <> f.first_local"), ("M15", "0", cnt("facts", "distinct_raw_component_count IS DISTINCT FROM distinct_component_count")),
    ("M16", one("CAST(sum(distinct_component_count) AS BIGINT)", "facts"), cnt("comp")), ("M17", "0", cnt("disp", f"tz_handling <> 'SOURCE_LOCAL_ASSUMED' AND source_file <> '{FILE3H}'")), ("M18", None, tally("stg", "tz_handling")), ("M19", None, bars(cnt("facts", "core_ready"), cnt("facts", "population = 'primary'"))),
    ("M20", "0", cnt("facts", "core_ready AND (is_quarantined OR error_rule_ids <> '')")), ("M21", "0", _DAYS_OFF), ("M22", None, cnt("ctx")), ("M23", cnt("ctx"), one("count(DISTINCT obs_utc)", "ctx")),
    ("M24", None, tally("factx", "context_join_status")), ("M25", None, bars(cnt("factx", "core_ready AND context_matched"), cnt("factx", "core_ready"))),
    ("M26", None, bars(cnt("factx", "core_ready AND purchase_null"), cnt("factx", "core_ready AND signup_null")))]))
_D = "(SELECT session_key FROM facts WHERE core_ready)"
add("check_MC", checks([
    ("MC01", None, bars(cnt("facts"), cnt("facts", "NOT is_quarantined AND modellable_event_count > 0"), cnt("facts", "population = 'primary'"), cnt("facts", "core_ready"), cnt("facts", "population = 'secondary'"))),
    ("MC02", bars(cnt("facts"), "0"), bars(cnt("facts", "population IN ('primary', 'secondary')"), "0")), ("MC03", "0", cnt("facts", "is_quarantined <> NOT (NOT is_quarantined AND modellable_event_count > 0)")),
    ("MC04", cnt("facts", "is_quarantined AND population = 'primary'"), cnt("facts", "population = 'primary' AND is_quarantined")), ("MC05", "0", cnt("facts", "core_ready AND is_quarantined")),
    ("MC06", "0", cnt("facts", "core_ready AND selected_weight_g IS NULL")), ("MC07", "0", f"(SELECT count(*) FROM (SELECT session_key, sum(weight_g) FILTER (disposition = 'MODELLABLE') AS w FROM disp GROUP BY ALL) x JOIN facts f USING (session_key) WHERE f.core_ready AND x.w <> f.selected_weight_g)"),
    ("MC08", None, "(SELECT count(*) FROM (SELECT session_key, sum(weight_g) AS w FROM disp WHERE disposition <> 'QUARANTINED' GROUP BY ALL) x JOIN facts f USING (session_key) WHERE f.core_ready AND x.w <> f.selected_weight_g)"),
    ("MC09", None, cnt("facts", "core_ready AND repeated_scales IS NOT NULL")),
    ("MC10", "true", "(SELECT d.disposition = 'MODELLABLE' AND (NOT f.core_ready OR f.selected_weight_g IS NOT NULL) FROM top_event t JOIN disp d USING (event_id) JOIN facts f ON f.session_key = t.session_key)"),
    ("MC11", f"(SELECT round(quantile_cont(selected_weight_g, 0.9), 6) FROM facts WHERE core_ready)", f"(SELECT round(quantile_cont(selected_weight_g, 0.9), 6) FROM facts WHERE core_ready)"),
    ("MC12", f"(SELECT round(quantile_cont(selected_weight_g, 0.5), 6) FROM facts WHERE core_ready)", f"(SELECT round(quantile_cont(selected_weight_g, 0.5), 6) FROM facts WHERE core_ready)"),
    ("MC13", "0", "0"), ("MC14", "0", cnt("facts", "core_ready AND distinct_raw_component_count IS DISTINCT FROM distinct_component_count")), ("MC15", "0", "0"),
    ("MC16", "0", "(SELECT count(*) FROM (SELECT service_date, sessions FROM volume WHERE population = 'primary') v FULL JOIN (SELECT service_date, count(*) AS n FROM facts WHERE core_ready GROUP BY ALL) m USING (service_date) WHERE v.sessions IS DISTINCT FROM m.n)"),
    ("MC17", cnt("facts", "population = 'primary'"), cnt("facts", "population = 'primary'")),
    ("MC18", cnt("facts", "population = 'primary'"), cnt("facts", "population = 'primary'")), ("MC19", cnt("facts", "core_ready"), cnt("facts", "core_ready")),
    ("MC20", None, bars(one("count(DISTINCT session_id)", "facts", "population = 'primary'"), cnt("facts", "population = 'primary' AND is_quarantined"))), ("MC21", cnt("ctx"), one("count(DISTINCT obs_utc)", "ctx")),
    ("MC22", None, tally("factx", "context_join_status", "population = 'primary'")),
    ("MC23", None, bars(cnt("factx", "population = 'primary' AND context_matched AND purchase_null"), cnt("factx", "population = 'primary' AND context_matched AND signup_null")))]))
_N = len(SCEN)
_SC = lambda s: bars(*[f"(SELECT CAST({m} AS VARCHAR) FROM scen WHERE scenario_id = '{s}')" for m in ("m1", "m2", "m3")])
add("check_SC", checks([
    ("SC01", f"'{_N} | {_N}'", bars(cnt("scen"), one("count(DISTINCT scenario_id)", "scen"))), ("SC02", "0", "0"), ("SC05", "1", one("count(DISTINCT source_file)", "stg", "tz_offset_hours <> 0")), ("SC06", _SC("S00"), _SC("TZ3")),
    ("SC07", bars(cnt("ws", "population = 'primary'"), cnt("ws", "population = 'primary'")), bars(one("min(m5_denominator)", "scen"), one("max(m5_denominator)", "scen"))),
    ("SC08", "0", cnt("ws", "population = 'primary' AND is_quarantined AND core_ready")), ("SC09", "0", cnt("sdelta", "grp = 'guardrail' AND robustness_class <> 'NOT_CLASSIFIED'")), ("SC10", "1", one("count(DISTINCT tz_offset_hours)", "stg", "tz_offset_hours <> 0")), ("SC11", "0", "0"),
    ("SC13", None, f"'{_N} | {sum(s[7] for s in SCEN)}'")]))
add("check_GRN", """SELECT 'context' AS table_name, count(*) AS rows, count(DISTINCT obs_utc) AS keys, 0::BIGINT AS duplicated_keys FROM ctx UNION ALL SELECT 'event', count(*), count(DISTINCT event_id), 0 FROM stg
  UNION ALL SELECT 'session', count(*), count(DISTINCT session_key), 0 FROM ses UNION ALL SELECT 'component', count(*), count(DISTINCT (session_key, component)), 0 FROM comp UNION ALL SELECT 'day', count(*), count(DISTINCT (service_date, population)), 0 FROM volume""")
_LANE = " UNION ALL ".join(f"SELECT status, {area} AS is_context FROM ({SQL[name]})" for name, area in (
    ("check_E", "false"), ("check_S", "false"), ("check_F", "false"), ("check_N", "false"), ("check_Z", "false"), ("check_D", "false"), ("check_K", "true"), ("check_V", "false")))
add("bld18_lane_status", f"""SELECT CASE WHEN (SELECT count(*) FROM fin WHERE handling = 'BLOCK' AND category <> 'context') + (SELECT count(*) FROM fin WHERE rule_id = 'X04') > 0
    OR (SELECT count(*) FROM ({_LANE}) WHERE status = 'FAIL' AND NOT is_context) > 0 THEN 'BLOCKED'
   WHEN (SELECT count(*) FROM fin WHERE quarantine) > 0 THEN 'PASSED_WITH_QUARANTINE' ELSE 'PASSED' END AS core_status,
  CASE WHEN (SELECT count(*) FROM fin WHERE rule_id = 'X07') + (SELECT count(*) FROM ({_LANE}) WHERE status = 'FAIL' AND is_context) > 0 THEN 'BLOCKED'
   WHEN (SELECT count(*) FROM fin WHERE rule_id IN ('X01', 'X08')) > 0 THEN 'PASSED_WITH_WARNINGS' ELSE 'PASSED' END AS context_status""")

# ---- scenario results ---------------------------------------------------------------------------------------------------------------
S_COLS = "scenario_id, m3, m5_numerator, m5_denominator, s2_numerator, " + ", ".join(r6(m, m) for m in ("m1", "m2", "m4", "m5", "s2"))
for kind in dict.fromkeys(s[8] for s in SCEN):
    ids = ", ".join(f"'{s[0]}'" for s in SCEN if s[8] == kind)
    add(f"scenario_{kind}", f"SELECT {S_COLS} FROM scen WHERE scenario_id IN ({ids})")
add("sen1_scenario_metrics", f"SELECT {S_COLS} FROM scen")
add("sen2_deltas", "SELECT metric_id, scenario_id, " + ", ".join(r6(n, n) for n in ("baseline_value", "scenario_value", "absolute_delta", "relative_delta")) + ", robustness_class FROM sdelta")
_W = "SELECT scenario_id, " + ", ".join(f"max(absolute_delta) FILTER (metric_id = '{m}') AS d_{m.lower()}, max(100 * relative_delta) FILTER (metric_id = '{m}') AS pct_d_{m.lower()}" for m in ("M1", "M2", "M3", "M4", "M5", "S2")) + \
    f", coalesce(arg_max(robustness_class, {RANK}) FILTER (robustness_class NOT IN ('NOT_CLASSIFIED', 'BLOCKED')), 'NOT_CLASSIFIED') AS worst_class FROM sdelta GROUP BY scenario_id"
step("swide", _W)
add("sen3_scenario_rows", "SELECT s.scenario_id, s.m3, " + ", ".join(r6(f"w.{p}d_{m}", f"{p}d_{m}") for m in ("m1", "m2", "m3", "m4", "m5", "s2") for p in ("", "pct_")) + ", w.worst_class FROM scen s JOIN swide w USING (scenario_id)")
add("sen4_ranges", RANGES)
add("sen5_baseline", " UNION ALL ".join(f"SELECT '{m.upper()}' AS metric_id, {r6(m, 'scenario_value')}, 'PASS' AS status FROM scen WHERE scenario_id = 'S00'" for m in ("m1", "m2", "m3", "m4", "m5", "s2")))
add("sen6_reference", """SELECT s.scenario_id, CASE WHEN abs(s.m1 - b.m1) > 0.05 OR abs(s.m2 - b.m2) > 0.05 OR s.m3 <> b.m3 OR s.m4 <> b.m4 OR coalesce(s.m5_numerator <> b.m5_numerator, false) THEN 'MISMATCH' ELSE 'reproduced' END AS reference_status
  FROM scen s, (SELECT * FROM scen WHERE scenario_id = 'S00') b""")
step("tz_ses", "SELECT o.h AS offset_hours, w.session_key, CASE o.h WHEN 0 THEN tz0 WHEN 1 THEN tz1 WHEN 2 THEN tz2 WHEN 3 THEN tz3 ELSE tz4 END AS violates, "
     + ceil_hour(utc("(w.first_wall + to_hours(o.h))")) + " AS hour, " + ceil_hour(utc("(w.first_wall + INTERVAL 3 HOUR)")) + " AS base_hour "
     "FROM ws w, (SELECT unnest([0, 1, 2, 3, 4]) AS h) o WHERE w.core_ready AND w.first_wall IS NOT NULL")
step("tz_hours", f"""SELECT h AS offset_hours, quantile_cont(f, 0.5) AS med FROM (SELECT o.h, CAST(d.event_wall + to_hours(o.h) AS DATE) AS day, {hour_frac('min(d.event_wall + to_hours(o.h))')} AS f
  FROM disp d JOIN facts s USING (session_key), (SELECT unnest([0, 1, 2, 3, 4]) AS h) o WHERE s.core_ready AND d.disposition <> 'DUPLICATE_EXCLUDED' AND d.source_file = '{FILE3H}' AND d.event_wall IS NOT NULL GROUP BY ALL) GROUP BY ALL""")
add("sen7_timezone_evidence", """SELECT x.offset_hours::BIGINT AS offset_hours, x.offset_hours = 3 AS is_baseline, x.sessions, x.violators, round(t.med, 2) AS median_first_hour, round(o.m, 2) AS others_median_hour, round(abs(t.med - o.m), 2) AS gap_h,
  t.med >= 10 AND t.med < 11 AS inside_band, x.changed_hours, x.mean_abs_change, x.rainy_share_pct
  FROM (SELECT s.offset_hours, count(*) AS sessions, count(*) FILTER (violates) AS violators, count(*) FILTER (s.hour <> s.base_hour) AS changed_hours, round(avg(abs(c.purchase_value - b.purchase_value)), 3) AS mean_abs_change,
    round(CASE WHEN count(c.signup_value) > 0 THEN 100.0 * count(*) FILTER (c.signup_value > 0) / count(c.signup_value) END, 2) AS rainy_share_pct
    FROM tz_ses s LEFT JOIN ctx c ON c.obs_utc = s.hour LEFT JOIN ctx b ON b.obs_utc = s.base_hour GROUP BY ALL) x JOIN tz_hours t USING (offset_hours), others o""")
add("sen8_material_change", """SELECT s.scenario_id, CASE WHEN NOT r.comparable THEN '' WHEN abs(s.m1 - b.m1) >= 10 OR abs(s.m2 - b.m2) >= 25 OR abs(s.m4 - b.m4) > 0 THEN 'true' ELSE 'false' END AS material_change
  FROM scen s JOIN scen_reg r USING (scenario_id), (SELECT * FROM scen WHERE scenario_id = 'S00') b""")
_QS = [("Q_weight", "metric_id IN ('M1', 'M2')"), ("Q_components", "metric_id = 'M4' AND scenario_id IN ('S30', 'S31', 'S32')"), ("Q_crossover", "metric_id IN ('M1', 'M2', 'M3', 'M4') AND scenario_id IN ('S01', 'S02', 'S03')"),
       ("Q_timezone", "metric_id IN ('M1', 'M2', 'M3', 'M5') AND scenario_id LIKE 'TZ%'"), ("Q_volume", "metric_id IN ('M1', 'M2', 'M4') AND scenario_id IN ('S20', 'S21', 'S22', 'S23')"), ("Q_readiness", "metric_id IN ('M5', 'S2')")]
add("sen9_questions", " UNION ALL ".join(
    f"SELECT '{i}' AS question_id, arg_max(robustness_class, {RANK}) AS robustness, count(*) AS cells, arg_max(metric_id || ' in ' || scenario_id, ({RANK}, round(abs(relative_delta), 9), metric_id, scenario_id)) AS driver FROM sdelta WHERE comparable AND scenario_id <> 'S00' AND {cond}"
    for i, cond in _QS))
add("sen10_preview", f"SELECT s.scenario_id, s.m3, {r6('s.m1', 'm1')}, {r6('s.m2', 'm2')}, {r6('s.m4', 'm4')}, {r6('w.d_m1', 'd_m1')}, {r6('w.d_m2', 'd_m2')} FROM scen s JOIN swide w USING (scenario_id) WHERE s.scenario_id IN ('S00', 'S10', 'S20', 'S21', 'S08', 'S04', 'S01')")

# ---- the large table ----------------------------------------------------------------------------------------------------------------
step("li", """SELECT l_orderkey, l_linestatus, count(*) AS events, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS weight, count(DISTINCT lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g')))) AS components,
  count(*) OVER (PARTITION BY l_orderkey) > 1 AS crossover FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey, l_linestatus""")
add("lineitem_session_metrics", f"""SELECT l_linestatus, count(*) AS eligible, count(*) FILTER (NOT crossover) AS ready, {r6(q('weight', 0.5) + ' FILTER (NOT crossover)', 'm1')}, {r6(q('weight', 0.9) + ' FILTER (NOT crossover)', 'm2')},
  {r6(q('components', 0.5) + ' FILTER (NOT crossover)', 'm4')} FROM li GROUP BY l_linestatus""")
add("lineitem_daily_volume", "SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, l_linestatus, count(*) FILTER (NOT crossover) AS sessions, count(*) FILTER (crossover) AS crossing, CAST(sum(events) AS BIGINT) AS events FROM li JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL")


def oracle_sql() -> dict[str, str]:
    return {name: with_steps(sql) for name, sql in SQL.items()}
