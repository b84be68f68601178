"""Aggregates that keep NULL apart from zero, and exact order statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from measurekit.config import Threshold



def when_true(cond: Column | None, value: Column) -> Column:
    return value if cond is None else F.when(cond, value)


def strict_sum(value: Column, where: Column | None = None) -> Column:
    """Sum over the chosen rows; NULL if there are none or any of them is NULL."""
    missing = value.isNull() if where is None else where & value.isNull()
    return F.when(F.count_if(missing) == 0, F.sum(when_true(where, value)))


def exact_median(value: Column) -> Column:
    return exact_percentile(value, 0.5)


def exact_percentile(value: Column, q: float, frequency: Column | None = None) -> Column:
    """Linear interpolation at (n - 1) * q of the sorted values. NULLs are not counted; no values give NULL."""
    if not 0 <= q <= 1:
        raise ValueError(f"q must lie in [0, 1], got {q}")
    if frequency is not None:
        return F.percentile(value, F.lit(q), frequency)
    return F.percentile(value, F.lit(q))


def first_row(order: list[Column], value: Column) -> Column:
    """`value` of the smallest row."""
    return F.min_by(value, F.struct(*order))


def last_row(order: list[Column], value: Column) -> Column:
    """`value` of the largest row."""
    return F.max_by(value, F.struct(*order))


def single_value(value: Column, text: bool = True) -> Column:
    """The one non-empty value of a group, NULL if there is none or several. Needs no set: one value means min = max."""
    v = F.nullif(value, F.lit("")) if text else value
    return F.when(F.min(v) == F.max(v), F.max(v))


def joined_set(value: Column, sep: str = ";") -> Column:
    """Sorted distinct values in one text. For values from a bounded vocabulary (files, scales, names) only."""
    return F.array_join(F.array_sort(F.collect_set(value)), sep)


def percent(num: Column, den: Column) -> Column:
    """100 * num / den; NULL for an empty denominator, never 0."""
    return F.when(den > 0, F.lit(100.0) * num / den)


def compare(value: Column, rule: Threshold) -> Column:
    """Predicate from an operator named in the configuration."""
    ops = {">": value > rule.value, ">=": value >= rule.value, "<": value < rule.value, "<=": value <= rule.value}
    if rule.operator not in ops:
        raise ValueError(f"unknown operator {rule.operator!r}")
    return ops[rule.operator]


def outside_closed(value: Column, low: float, high: float) -> Column:
    return (value < low) | (value > high)


def inside_half_open(value: Column, low: float, high: float) -> Column:
    return (value >= low) & (value < high)
