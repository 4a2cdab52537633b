"""Epoch arithmetic on columns. Wall times without a zone are UTC, as the session's zone must be."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2024-01-01T00:00:00Z in seconds: the earliest instant that a stored count can stand for.
EPOCH_2024_S = 1_704_067_200


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone."""
    return F.unix_micros(ts.cast("timestamp"))


def wall_ns(ts: Column) -> Column:
    """Nanoseconds since the epoch of a timestamp."""
    return micros(ts) * F.lit(1000)


def nanos_of(count: Column, earliest_s: int = EPOCH_2024_S) -> Column:
    """Brings a count since the epoch, written in s, ms, us or ns, to nanoseconds.

    The finest unit that puts the instant at or after ``earliest_s`` is the one meant. NULL, and a count
    that is earlier in every unit, give NULL.
    """
    low = earliest_s
    return (
        F.when(count >= F.lit(low * 10**9), count)
        .when(count >= F.lit(low * 10**6), count * F.lit(10**3))
        .when(count >= F.lit(low * 10**3), count * F.lit(10**6))
        .when(count >= F.lit(low), count * F.lit(10**9))
    )
