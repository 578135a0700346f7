"""Time functions on epoch microseconds / seconds in UTC, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
HOUR = 3_600 * SECOND
DAY = 24 * HOUR


def epoch_micros(ts: str) -> Column:
    """Epoch microseconds of a wall-clock (UTC) timestamp column."""
    since = f"CAST(CAST({ts} AS TIMESTAMP_NTZ) - TIMESTAMP_NTZ'1970-01-01 00:00:00' AS INTERVAL SECOND)"
    return F.expr(f"CAST(CAST({since} AS DECIMAL(18, 6)) * 1000000 AS BIGINT)")


def whole(numerator: Column, width: int) -> Column:
    """Floor division as BIGINT."""
    return F.call_function("div", numerator - F.pmod(numerator, F.lit(width)), F.lit(width)).cast("bigint")


def hour_of_day(epoch_seconds: Column) -> Column:
    return whole(F.pmod(epoch_seconds, F.lit(86_400)), 3_600).cast("int")


def weekday(epoch_seconds: Column) -> Column:
    """Monday = 0; the epoch was a Thursday."""
    return F.pmod(whole(epoch_seconds, 86_400) + 3, F.lit(7)).cast("int")


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of ``value`` on a circle of ``period`` steps."""
    angle = F.lit(2.0) * F.pi() * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def date_of(micros: Column) -> Column:
    """UTC calendar date of epoch microseconds."""
    return F.date_add(F.lit("1970-01-01").cast("date"), whole(micros, DAY).cast("int"))


def date_window(as_of: str, days: int) -> list[str]:
    """The ISO dates of ``as_of`` and the days before it, newest first."""
    import datetime

    last = datetime.date.fromisoformat(as_of)
    return [(last - datetime.timedelta(days=i)).isoformat() for i in range(days)]
