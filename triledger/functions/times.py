"""Wall-clock times as numbers and text, independent of the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without zone."""
    day = F.unix_date(F.to_date(ts)).cast("bigint")
    seconds = day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def day_text(day: Column) -> Column:
    return F.to_date(day).cast("string")


def month_of(day: Column) -> Column:
    """yyyy-MM of a date or time."""
    return F.substring(day_text(day), 1, 7)
