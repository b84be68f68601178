"""Small verbatim tables for boundary tests."""

from __future__ import annotations

import datetime as dt

from measurekit.config import Config, Threshold, TimeOverride
from measurekit.plans.measurement import Measurement

FIELDS = ("source_file", "source_row_number", "session_id", "weighing_event_time", "weighting_type", "scale_identifier", "weight_of_a_component",
          "component_name", "tray_id", "user_identification_time")
SCHEMA = ", ".join(f"{f} {'bigint' if f == 'source_row_number' else 'string'}" for f in FIELDS)

CFG = Config(
    populations=(("registered_", "primary"), ("non_registered_", "other")), primary="primary", other="other", zone="Europe/Helsinki",
    window=(dt.date(2020, 10, 5), dt.date(2020, 11, 20)), context_window=(dt.datetime(2020, 10, 6, 6), dt.datetime(2020, 10, 6, 12)),
    context_station="100", context_parameters=("t2m", "r_1h"),
    overrides=(TimeOverride("registered_shifted.csv", "PLUS_3H", 3, "evidence", dt.date(2020, 10, 5), dt.date(2020, 10, 16), (7.0, 8.5)),),
    scale_kinds=(("lammin", "hot (lammin)"), ("salaatti", "cold (salaatti)")), hot_kind="lammin", twin_sides=("vasen", "oikea"),
    session_span=Threshold(">", 600), day_minimum=30,
    weekday_regime={"Monday": "high", "Tuesday": "high", "Wednesday": "high", "Thursday": "low", "Friday": "low"},
    baseline=(dt.date(2020, 10, 5), dt.date(2020, 10, 30)))


def row(n: int, **kw) -> tuple:
    base = {"source_file": "registered_a.csv", "source_row_number": n, "session_id": "s1", "weighing_event_time": f"2020-10-06 11:00:{n % 60:02d}",
            "weighting_type": "line", "scale_identifier": "koti2-vasen-salaatti3", "weight_of_a_component": "100", "component_name": "salad",
            "tray_id": "t1", "user_identification_time": "2020-10-06 11:05:00"}
    base.update(kw)
    return tuple(base[f] for f in FIELDS)


def raw(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def observations(spark, rows):
    return spark.createDataFrame(rows, "observation_id string, source_file string, station string, time_raw string, parameter string, value_raw string")


def measure(spark, rows, obs=(), cfg=CFG) -> Measurement:
    return Measurement(raw(spark, list(rows)), observations(spark, list(obs)) if obs else None, cfg)


def one(df, **where):
    rows = [r for r in df.collect() if all(r[k] == v for k, v in where.items())]
    assert len(rows) == 1, rows
    return rows[0]


def hits(df, rule: str, column: str = "entity_id") -> list:
    return sorted(r[column] for r in df.collect() if r["rule_id"] == rule)
