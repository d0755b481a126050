"""Calendar features of a timestamp column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(ts: Column) -> dict[str, Column]:
    hour, day_of_week = F.hour(ts), F.weekday(ts)
    return {
        "hour": hour,
        "day_of_week": day_of_week,
        "day_of_month": F.dayofmonth(ts),
        "month": F.month(ts),
        "minute": F.minute(ts),
        "second": F.second(ts).cast("int"),
        "is_weekend": flag(day_of_week >= 5),
        "is_business_hours": flag(hour.between(9, 17)),
        "is_night": flag((hour >= 22) | (hour <= 6)),
    }


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it fails or is unknown."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a naive timestamp (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def bucket(ts: Column, unit: str) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")
