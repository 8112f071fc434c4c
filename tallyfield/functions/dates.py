"""Calendar columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar_parts(date: Column) -> list[Column]:
    """year, month, day and weekday (Sunday is 1)."""
    return [
        F.year(date).alias("year"),
        F.month(date).alias("month"),
        F.dayofmonth(date).alias("day"),
        F.dayofweek(date).alias("wday"),
    ]


def month_start(year: Column, month: Column) -> Column:
    return F.make_date(year.cast("int"), month.cast("int"), F.lit(1))


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)
