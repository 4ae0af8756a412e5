"""Timestamps without a zone."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_wall_clock(text: Column, pattern: str) -> Column:
    """Text to timestamp_ntz, null when the text does not match.

    The tolerant parser yields instants in the session zone, where daylight saving
    would move some times. So the text is read as UTC, and the seconds since the
    epoch are put on the zone-free epoch.
    """
    instant = F.try_to_timestamp(F.concat(text, F.lit("Z")), F.lit(pattern + "X"))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("SECOND", F.unix_seconds(instant), epoch)


def _minute(ts: Column) -> Column:
    return F.unix_date(F.to_date(ts)).cast("long") * 1440 + F.hour(ts) * 60 + F.minute(ts)


def time_slice(ts: Column, minutes: int) -> Column:
    """Number of the ``minutes``-long slice that holds ``ts``; grows with time."""
    return F.floor(_minute(ts) / minutes)


def time_micros(ts: Column) -> Column:
    """Microseconds of ``ts``, to its full precision; grows with time."""
    seconds = F.extract(F.lit("SECONDS"), ts)
    return _minute(ts) * 60_000_000 + (seconds * 1_000_000).cast("long")
