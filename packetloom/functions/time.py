"""Event times."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def event_time(s: Column) -> Column:
    """Timestamp of an ISO string with Z, +00:00 or +0000, or without an offset (UTC); null if it is none."""
    colon = F.regexp_replace(s, "([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    return F.try_to_timestamp(colon)


def epoch(ts: Column) -> Column:
    """Seconds since 1970 as a double."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def bucket(ts: Column, seconds: int) -> Column:
    """Number of the epoch-aligned window of that many seconds."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def iso(ts: Column) -> Column:
    """2024-01-31T23:59:59Z."""
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
