"""Time columns: two source formats, clock corrections, local to UTC without guessing. All values are zone-less timestamps."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from measurekit.config import SOURCE_LOCAL, TimeOverride
from measurekit.functions.text import strip

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

# year, month, day with one separator throughout, and a clock time; nothing may follow
_SHAPE = "^[0-9]{4}([-.])[0-9]{1,2}\\1[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$"


def hours(n: Column | int) -> Column:
    return F.make_dt_interval(hours=F.lit(n) if isinstance(n, int) else n)


def minutes(n: int) -> Column:
    return F.make_dt_interval(mins=F.lit(n))


def parse_time(c: Column) -> Column:
    """Wall time from `yyyy-MM-dd HH:mm:ss` or `yyyy.MM.dd HH:mm:ss`; anything else is NULL."""
    text = strip(c)
    return F.when(text.rlike(_SHAPE), F.replace(text, F.lit("."), F.lit("-")).try_cast("timestamp_ntz"))


def time_format(c: Column, parsed: Column) -> Column:
    """dash | dot for a time that parsed, else NULL."""
    return F.when(parsed.isNull(), F.lit(None)).when(c.contains("."), "dot").otherwise("dash")


def parse_utc(c: Column) -> Column:
    """Strict `yyyy-MM-ddTHH:mm:ssZ`, as a zone-less UTC timestamp."""
    return F.when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"),
                  F.regexp_replace(c, "Z$", "").try_cast("timestamp_ntz"))


def override_offset(file_name: Column, overrides: Iterable[TimeOverride]) -> Column:
    """Hours to add for the named files, 0 for every other file."""
    out = F.lit(0)
    for o in overrides:
        out = F.when(file_name == o.source_file, F.lit(o.offset_hours)).otherwise(out)
    return out


def override_label(file_name: Column, overrides: Iterable[TimeOverride]) -> Column:
    out = F.lit(SOURCE_LOCAL)
    for o in overrides:
        out = F.when(file_name == o.source_file, F.lit(o.label)).otherwise(out)
    return out


def override_reason(file_name: Column, overrides: Iterable[TimeOverride]) -> Column:
    out = F.lit("no file-specific correction")
    for o in overrides:
        out = F.when(file_name == o.source_file, F.lit(o.reason)).otherwise(out)
    return out


def to_zone(utc: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def utc_candidate(local: Column, zone: str) -> Column:
    """What Spark makes of a wall time; for an ambiguous or missing wall time this is a guess, see `local_status`."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)


def status_of(local: Column, candidate: Column, zone: str, shift_minutes: int = 60) -> Column:
    """OK | AMBIGUOUS | NONEXISTENT | UNPARSEABLE (NULL) of a wall time, from its `utc_candidate`.

    For zones that shift by `shift_minutes`. Give the candidate as a column of its own, so it is worked out once.
    """
    again = (to_zone(candidate + minutes(shift_minutes), zone) == local) | (to_zone(candidate - minutes(shift_minutes), zone) == local)
    return (F.when(local.isNull(), "UNPARSEABLE")
            .when(to_zone(candidate, zone) != local, "NONEXISTENT")
            .when(again, "AMBIGUOUS")
            .otherwise("OK"))


def local_status(local: Column, zone: str) -> Column:
    return status_of(local, utc_candidate(local, zone), zone)


def local_to_utc(local: Column, zone: str) -> Column:
    """UTC where the wall time names exactly one instant, else NULL."""
    return F.when(local_status(local, zone) == "OK", utc_candidate(local, zone))


def raw_wall(local: Column, offset_hours: Column) -> Column:
    """The time as written in the source: the treated time minus the correction."""
    return local - hours(offset_hours)


def hour_fraction(t: Column) -> Column:
    return F.hour(t) + F.minute(t) / 60 + F.floor(F.second(t)) / 3600


def floor_hour(t: Column) -> Column:
    """Start of the hour. Not `date_trunc`, which goes through the session zone."""
    return t.cast("date").cast("timestamp_ntz") + hours(F.hour(t))


def ceil_hour(t: Column) -> Column:
    """End of the hour that contains t; an exact hour keeps itself."""
    floor = floor_hour(t)
    return F.when(floor == t, floor).otherwise(floor + hours(1))


def seconds_between(a: Column, b: Column) -> Column:
    """Whole seconds from a to b, without the session zone."""
    return (b - a).cast("interval second").cast("bigint")


def weekday_name(d: Column) -> Column:
    return F.when(d.isNotNull(), F.element_at(F.array(*[F.lit(w) for w in WEEKDAYS]), F.weekday(d) + 1))


def is_weekend(d: Column) -> Column:
    return F.weekday(d) >= 5


def week_start(d: Column) -> Column:
    return F.date_sub(d, F.weekday(d))


def iso_text(t: Column) -> Column:
    return t.cast("string")
