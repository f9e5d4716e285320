"""Half-open time ranges as structs of ``start`` and ``end``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"))


def centered(at: Column, half: Column) -> Column:
    """From ``half`` before (0 at least) to ``half`` after."""
    return make(F.greatest(F.lit(0).cast("long"), at - half), at + half)


def duration(r: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), r["end"] - r["start"])


def is_empty(r: Column) -> Column:
    return r["start"] >= r["end"]


def contains(r: Column, at: Column) -> Column:
    return (at >= r["start"]) & (at < r["end"])


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def intersection(a: Column, b: Column) -> Column:
    """What both have, null if nothing."""
    return F.when(overlaps(a, b), make(F.greatest(a["start"], b["start"]), F.least(a["end"], b["end"])))


def extend_to(r: Column, at: Column) -> Column:
    """The least range that holds ``r`` and reaches ``at``."""
    return make(F.least(r["start"], at), F.greatest(r["end"], at))
