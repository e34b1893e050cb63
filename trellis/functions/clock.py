"""Time helpers that do not depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros_of(ts: str) -> Column:
    """Microseconds since 1970 of a zone-free timestamp column (null stays null)."""
    return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, CAST({ts} AS TIMESTAMP_NTZ))")


def iso_micros(text: Column, whole_seconds: bool = False) -> Column:
    """Microseconds since 1970 in UTC of an ISO-8601 string with or without an offset.

    A string without an offset counts as UTC; one that cannot be read gives null.
    """
    t = F.trim(text)
    zoned = F.when(t.rlike(r"(Z|z|[+-]\d{2}:?\d{2})$"), t).otherwise(F.concat(t, F.lit("Z")))
    us = F.unix_micros(F.try_to_timestamp(zoned))
    return F.floor(us / 1000000) * 1000000 if whole_seconds else us


def month_of(us: Column) -> Column:
    """'YYYY-MM' of microseconds since 1970, in UTC."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / 86400000000).cast("int")), "yyyy-MM")
