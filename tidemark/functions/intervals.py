"""Lengths of intervals as columns; `tidemark.schema` has them for plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schema import INTERVALS

_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def seconds_of(interval: Column, default: int = 60) -> Column:
    """Seconds of an interval: a named one, else a number with unit s, m, h or d in any case; null and anything else are `default`."""
    t = F.lower(F.trim(F.coalesce(interval, F.lit(""))))
    named = F.create_map(*[F.lit(x) for kv in INTERVALS.items() for x in kv])
    unit = F.coalesce(*[F.when(F.endswith(t, F.lit(u)), n) for u, n in _UNITS.items()])
    number = F.regexp_extract(t, "^([0-9]{1,15})[smhd]$", 1)
    free = F.when(number != "", F.greatest(F.lit(1), F.nullif(number, F.lit("")).cast("bigint")) * unit)
    return F.coalesce(F.try_element_at(named, t), free, F.lit(default)).cast("bigint")


def refresh_of(interval: Column, fraction: float = 1 / 12, low: float = 1.0, high: float = 15.0) -> Column:
    """How often an interval is polled: a share of its length within bounds; high <= 0 means no upper bound."""
    s = F.greatest(F.lit(low), seconds_of(interval) * fraction)
    return F.least(s, F.lit(high)) if high > 0 else s
