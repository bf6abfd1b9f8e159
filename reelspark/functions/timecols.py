"""Time helpers that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def ntz(text: str) -> Column:
    """A TIMESTAMP_NTZ literal, e.g. ``ntz('2024-01-15 00:00:00')``."""
    return F.expr(f"TIMESTAMP_NTZ'{text}'")


def as_ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def epoch_ms(c: Column) -> Column:
    """Whole milliseconds since the epoch (floor) of a wall-clock (NTZ) timestamp."""
    us = epoch_us(c)
    return ((us - F.pmod(us, F.lit(1000))) / F.lit(1000)).cast("bigint")


def epoch_us(c: Column) -> Column:
    """Microseconds since the epoch of a wall-clock (NTZ) timestamp.

    Built from the date and the time-of-day parts, which never pass through
    the session time zone (``timestampdiff`` would cast to a zoned timestamp
    and shift across daylight-saving changes).
    """
    t = as_ntz(c)
    days = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("bigint")
    secs = F.date_part(F.lit("SECOND"), t)  # decimal(8,6): seconds with fraction
    return (days * 86_400_000_000 + F.hour(t).cast("bigint") * 3_600_000_000
            + F.minute(t).cast("bigint") * 60_000_000 + (secs * 1_000_000).cast("bigint"))


def from_epoch_us(us: Column) -> Column:
    """The wall-clock (NTZ) timestamp of microseconds since the epoch (inverse of :func:`epoch_us`)."""
    return F.expr(_EPOCH) + F.make_dt_interval(secs=(us.cast("decimal(18,0)") / F.lit(1_000_000)).cast("decimal(18,6)"))


def plus(c: Column, *, hours: float = 0, minutes: float = 0, seconds: float = 0) -> Column:
    """``c + interval`` with the amount given in hours / minutes / seconds."""
    micros = int(round((hours * 3600 + minutes * 60 + seconds) * 1_000_000))
    return c + F.make_dt_interval(secs=F.lit(micros / 1_000_000).cast("decimal(18,6)"))
