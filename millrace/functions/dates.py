"""Column functions over time stamps without a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970, whatever the session's time zone."""
    days = F.date_diff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    second = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return ((days * 24 + F.hour(ts)) * 60 + F.minute(ts)) * 60_000_000 + second


def minutes_between(first: Column, last: Column) -> Column:
    return (epoch_micros(last) - epoch_micros(first)) / 60_000_000.0


def within(ts: Column, as_of: str, hours: int) -> Column:
    """Whether ts lies in the ``hours`` before ``as_of``; a fixed moment, so that results repeat."""
    end = F.lit(as_of).cast("timestamp_ntz")
    return (ts > end - F.expr(f"INTERVAL {hours} HOURS")) & (ts <= end)
