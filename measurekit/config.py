"""Configuration as data: populations, time-zone overrides, thresholds and the rule catalogue.

Changing a threshold, a severity or a handling never changes code: every operator reads these values.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

ERROR, WARN, INFO = "ERROR", "WARN", "INFO"
FLAG, QUARANTINE, BLOCK, KEEP_FIRST = "FLAG", "QUARANTINE", "BLOCK", "KEEP_FIRST"

SOURCE_LOCAL = "SOURCE_LOCAL_ASSUMED"


@dataclass(frozen=True)
class RuleSpec:
    rule_id: str
    category: str
    severity: str
    handling: str


# Rule ids, categories, severities and handlings, in catalogue order.
_RULES = (
    ("S03", "structure", INFO, FLAG),
    ("S04", "structure", WARN, FLAG),
    ("S05", "structure", ERROR, QUARANTINE),
    ("S06", "structure", ERROR, QUARANTINE),
    ("S07", "structure", ERROR, QUARANTINE),
    ("S08", "structure", WARN, FLAG),
    ("B01", "business", ERROR, QUARANTINE),
    ("B02", "business", WARN, FLAG),
    ("B03", "business", INFO, FLAG),
    ("B04", "business", WARN, FLAG),
    ("B05", "business", INFO, FLAG),
    ("B07", "business", WARN, FLAG),
    ("T01", "time", ERROR, QUARANTINE),
    ("T02", "time", WARN, FLAG),
    ("T03", "time", ERROR, QUARANTINE),
    ("T04", "time", WARN, FLAG),
    ("T05", "time", WARN, FLAG),
    ("T06", "time", WARN, FLAG),
    ("T07", "time", WARN, FLAG),
    ("T08", "time", INFO, FLAG),
    ("T10", "time", ERROR, BLOCK),
    ("I01", "identity", ERROR, QUARANTINE),
    ("I02", "identity", WARN, KEEP_FIRST),
    ("I04", "identity", ERROR, QUARANTINE),
    ("I06", "identity", WARN, FLAG),
    ("I07", "identity", INFO, FLAG),
    ("X01", "context", WARN, FLAG),
    ("X03", "context", INFO, FLAG),
    ("X04", "context", ERROR, BLOCK),
    ("X07", "context", ERROR, BLOCK),
    ("X08", "context", WARN, FLAG),
    ("C01", "coverage", WARN, FLAG),
    ("C02a", "coverage", INFO, FLAG),
    ("C02b", "coverage", WARN, FLAG),
    ("C03", "coverage", WARN, FLAG),
    ("C04", "coverage", ERROR, BLOCK),
)

CONTEXT_RULES = ("X01", "X03", "X07", "X08")
SESSION_WARN_RULES = ("B04", "B07", "T04", "T05", "I06")
EVENT_WARN_RULES = ("B02", "I02")


def rule_catalogue(overrides: dict[str, tuple[str, str]] | None = None) -> dict[str, RuleSpec]:
    """Rule id -> spec, with (severity, handling) replaced where configured. Unknown rule ids in `overrides` are ignored."""
    specs = {r[0]: RuleSpec(*r) for r in _RULES}
    for rule_id, (severity, handling) in (overrides or {}).items():
        if rule_id in specs:
            specs[rule_id] = replace(specs[rule_id], severity=severity, handling=handling)
    return specs


@dataclass(frozen=True)
class TimeOverride:
    """A file-specific clock correction and the evidence range it holds for."""

    source_file: str
    label: str
    offset_hours: int
    reason: str
    first_date: dt.date
    last_date: dt.date
    raw_hour_band: tuple[float, float]      # closed


@dataclass(frozen=True)
class Threshold:
    operator: str
    value: float


@dataclass(frozen=True)
class Config:
    """Everything the operators need to know about one source."""

    populations: tuple[tuple[str, str], ...]            # (file name prefix, population)
    primary: str
    other: str
    zone: str
    window: tuple[dt.date, dt.date]                     # study window, both ends included
    context_window: tuple[dt.datetime, dt.datetime]     # UTC hours, both ends included
    context_station: str
    context_parameters: tuple[str, ...]
    overrides: tuple[TimeOverride, ...] = ()
    large_weight: Threshold = Threshold(">=", 1500)     # B02
    trace_weight: Threshold = Threshold("<=", 3)        # B03
    session_weight: tuple[float, float] = (50, 2200)    # B07, closed
    session_span: Threshold = Threshold(">", 600)       # T05
    service_hours: tuple[int, int] = (9, 15)            # T03, [low, high)
    first_hour_band: tuple[float, float] = (10.0, 11.0)  # T07, [low, high)
    day_minimum: int = 30                               # C02a
    weekday_regime: dict[str, str] = field(default_factory=dict)
    baseline: tuple[dt.date, dt.date] | None = None
    rule_overrides: dict[str, tuple[str, str]] = field(default_factory=dict)
    scale_kinds: tuple[tuple[str, str], ...] = ()       # (word in a scale's identifier, label), first match counts
    hot_kind: str = ""                                  # the word of scales that keep food warm
    twin_sides: tuple[str, ...] = ()                    # words that tell twin scales apart

    @property
    def catalogue(self) -> dict[str, RuleSpec]:
        return rule_catalogue(self.rule_overrides)

    def rules_with(self, *, severity: str | None = None, handling: str | None = None) -> tuple[str, ...]:
        return tuple(r.rule_id for r in self.catalogue.values()
                     if (severity is None or r.severity == severity) and (handling is None or r.handling == handling))
