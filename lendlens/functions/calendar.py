"""Calendar parts and flags of a timestamp column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
WEEKEND_DAYS = [5, 6]
HOLIDAY_MONTHS = [11, 12]
BUSINESS_HOURS = (9, 17)
LATE_HOURS = [22, 23, 0, 1, 2, 3, 4, 5]


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def is_weekend(ts: Column) -> Column:
    return flag(F.weekday(ts).isin(WEEKEND_DAYS))


def is_month_end(ts: Column, first_day: int = 25) -> Column:
    return flag(F.dayofmonth(ts) >= first_day)


def is_holiday_season(ts: Column) -> Column:
    return flag(F.month(ts).isin(HOLIDAY_MONTHS))


def is_business_hours(ts: Column) -> Column:
    return flag(F.hour(ts).between(*BUSINESS_HOURS))


def is_late_night(ts: Column) -> Column:
    return flag(F.hour(ts).isin(LATE_HOURS))


def week_of_month(ts: Column) -> Column:
    return (F.floor((F.dayofmonth(ts) - 1) / 7) + 1).cast("int")


def time_of_day(ts: Column) -> Column:
    """Right-closed bins: hour 6 is night, 12 morning, 18 afternoon."""
    hour = F.hour(ts)
    return (
        F.when(hour <= 6, "night").when(hour <= 12, "morning")
        .when(hour <= 18, "afternoon").when(hour <= 24, "evening")
    )
