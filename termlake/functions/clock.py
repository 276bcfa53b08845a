"""Time of the query and random numbers: the session's clock, alike for all rows of a query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def now() -> Column:
    return F.current_timestamp()


def unix_ns(at: Column | None = None) -> Column:
    """Nanoseconds since 1970, to the microsecond."""
    return F.unix_micros(now() if at is None else at) * 1000


def unix_ms(at: Column | None = None) -> Column:
    return F.unix_millis(now() if at is None else at)


def unix(at: Column | None = None) -> Column:
    return F.unix_seconds(now() if at is None else at)


def rand(seed: int | None = None) -> Column:
    """A number from 0 to below 1 for each row."""
    return F.rand() if seed is None else F.rand(seed)
