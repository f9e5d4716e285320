"""Buffer flags as bits of an integer column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowframe import schema


def contains(flags: Column, bits: int) -> Column:
    return flags.bitwiseAND(bits) == bits


def insert(flags: Column, bits: int) -> Column:
    return flags.bitwiseOR(bits)


def remove(flags: Column, bits: int) -> Column:
    return flags.bitwiseAND(~bits)


def toggle(flags: Column, bits: int) -> Column:
    return flags.bitwiseXOR(bits)


def is_keyframe(flags: Column) -> Column:
    """A point where decoding can begin: marked so, and not a delta."""
    return contains(flags, schema.SYNC_POINT) & ~contains(flags, schema.DELTA)


def names(flags: Column) -> Column:
    """The names of the bits set, in order of bits."""
    return F.filter(F.array(*(F.when(contains(flags, bit), F.lit(name)) for name, bit in schema.FLAGS.items())), lambda x: x.isNotNull())


def effective_dts(dts: Column, pts: Column) -> Column:
    return F.coalesce(dts, pts)


def content_hash(payload: Column) -> Column:
    """A 64-bit hash for dealing rows out; equality is decided on the payload."""
    return F.xxhash64(payload)
