"""Tag lists as maps from names to values, and the four ways to merge them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge(old: Column, new: Column, mode: str) -> Column:
    """``replace``: only the new tags; ``append``: all, the new value where both have one; ``keep``: all, the old value
    where both have one; ``replace_matching``: the old names only, with new values where there are any."""
    rest_old = F.map_filter(old, lambda k, v: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    rest_new = F.map_filter(new, lambda k, v: ~F.coalesce(F.map_contains_key(old, k), F.lit(False)))
    if mode == "replace":
        return new
    if mode == "append":
        return F.map_concat(rest_old, new)
    if mode == "keep":
        return F.map_concat(old, rest_new)
    if mode == "replace_matching":
        return F.map_concat(rest_old, F.map_filter(new, lambda k, v: F.map_contains_key(old, k)))
    raise ValueError(f"no such mode: {mode}")
