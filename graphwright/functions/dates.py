"""Dates and Unix seconds, in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_of(epoch: Column) -> Column:
    """YYYY-MM-DD of Unix seconds."""
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd")


def day_start(day: Column) -> Column:
    """Unix seconds of a day's start; null if the date is invalid."""
    return F.unix_timestamp(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")))


def day_end(day: Column) -> Column:
    """Unix seconds of a day's last second."""
    return day_start(day) + F.lit(86399)


def days_before(day: Column, n: int | Column) -> Column:
    n = n.cast("int") if isinstance(n, Column) else n
    return F.date_format(F.date_sub(F.to_date(day), n), "yyyy-MM-dd")


def today_minus(n: int | Column) -> Column:
    return days_before(F.current_date(), n)
