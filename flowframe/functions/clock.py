"""Clock arithmetic on nanosecond columns; null is "no time"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowframe.schema import floor_div

MAX = 9223372036854775807
UNITS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000}


def of(value: Column, unit: str) -> Column:
    return value.cast("long") * UNITS[unit]


def to(ns: Column, unit: str) -> Column:
    """Whole units, cut."""
    return floor_div(ns, UNITS[unit])


def seconds(ns: Column) -> Column:
    return ns / 1e9


def saturating_sub(a: Column, b: Column) -> Column:
    """``a - b``, but never below 0."""
    return F.when((a - b).isNotNull(), F.greatest(F.lit(0).cast("long"), a - b))


def saturating_add(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_add(a, b), F.when(a.isNotNull() & b.isNotNull(), F.lit(MAX)))


def checked_add(a: Column, b: Column) -> Column:
    """``a + b``, null if it does not fit."""
    return F.try_add(a, b)


def checked_sub(a: Column, b: Column) -> Column:
    """``a - b``, null if it would be below 0."""
    return F.when(a >= b, a - b)


def saturating_mul(a: Column, by: int) -> Column:
    """``a`` times a whole number, at most ``MAX``."""
    return F.coalesce(F.try_multiply(a, F.lit(by).cast("long")), F.when(a.isNotNull(), F.lit(MAX)))


def checked_div(a: Column, by: int) -> Column:
    """Whole part of ``a`` over a whole number, null for 0."""
    return floor_div(a, by) if by else F.when(F.lit(False), a)


def abs_diff(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def within_tolerance(a: Column, b: Column, tolerance: int) -> Column:
    return abs_diff(a, b) <= tolerance


def display(ns: Column) -> Column:
    """Seconds and milliseconds: ``1.500s``."""
    return F.format_string("%d.%03ds", floor_div(ns, 1_000_000_000), floor_div(ns, 1_000_000) % 1000)
