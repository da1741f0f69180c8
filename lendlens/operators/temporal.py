"""Row-level time features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lendlens.functions import calendar as cal


def temporal_features(df: DataFrame, timestamp: str = "transaction_timestamp",
                      month_end_from: int = 25) -> DataFrame:
    """Adds hour, day, month parts, flags and the time-of-day bin as one projection."""
    ts = F.col(timestamp).cast("timestamp")
    return df.withColumns({
        timestamp: ts,
        "transaction_hour": F.hour(ts),
        "transaction_day_of_week": F.weekday(ts),
        "transaction_month": F.month(ts),
        "transaction_day_of_month": F.dayofmonth(ts),
        "week_of_month": cal.week_of_month(ts),
        "is_weekend": cal.is_weekend(ts),
        "is_month_end": cal.is_month_end(ts, month_end_from),
        "is_holiday_season": cal.is_holiday_season(ts),
        "is_business_hours": cal.is_business_hours(ts),
        "is_late_night": cal.is_late_night(ts),
        "time_of_day": cal.time_of_day(ts),
    })


FLAGS = {
    "is_weekend": "weekend_rate",
    "is_month_end": "month_end_rate",
    "is_holiday_season": "holiday_rate",
    "is_business_hours": "business_hours_rate",
    "is_late_night": "late_night_rate",
}


def temporal_flag_rates(df: DataFrame) -> DataFrame:
    return df.agg(*[F.avg(flag).alias(rate) for flag, rate in FLAGS.items()])
