"""Business-calendar expressions.

Timestamps are either zone-aware (converted to the restaurant clock) or naive local time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the restaurants' clock.
BUSINESS_ZONE = "Asia/Karachi"


def local_time(instant: Column, zone: str = BUSINESS_ZONE) -> Column:
    """A zone-aware timestamp as naive wall-clock time of the business zone, whatever the session's zone."""
    seconds = (F.unix_micros(instant).cast("decimal(24,0)") / 1_000_000).cast("decimal(18,6)")
    utc = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds)
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def day_start(moment: Column) -> Column:
    """Local midnight of the day a moment falls in."""
    return F.date_trunc("day", moment)


def day_after(moment: Column) -> Column:
    """Local midnight after the day a moment falls in (exclusive end of an inclusive date)."""
    return F.date_trunc("day", moment) + F.expr("INTERVAL 1 DAY")


def whole_days(start: Column, end: Column) -> Column:
    """Completed days between two timestamps, rounded down."""
    return F.timestamp_diff("DAY", start, end)


def with_calendar(df: DataFrame, moment: str) -> DataFrame:
    """Local date, hour, year, month and Monday-based weekday of a timestamp."""
    at = F.col(moment)
    return df.withColumns(
        {
            "Local_Date": F.to_date(at),
            "Local_Hour": F.hour(at),
            "Local_Year": F.year(at),
            "Local_Month": F.month(at),
            "Local_Weekday": F.weekday(at),
        }
    )


def calendar_features(df: DataFrame, day: str) -> DataFrame:
    """Weekday (Monday 0), day, month, weekend flag, ISO week and day name."""
    at = F.col(day)
    return df.withColumns(
        {
            "day_of_week": F.weekday(at),
            "day": F.dayofmonth(at),
            "month": F.month(at),
            "is_weekend": (F.weekday(at) >= 5).cast("int"),
            "week_of_year": F.weekofyear(at),
            "day_name": F.date_format(at, "EEEE"),
        }
    )
