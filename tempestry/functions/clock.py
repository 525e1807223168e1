"""Time arithmetic on timestamps without time zone, exact to the microsecond.

Nothing here goes through the session time zone, so daylight saving of the
session cannot shift or merge hours.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000
HOURS_PER_DAY = 24.0
DAYS_PER_YEAR = 365.0


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 on the clock of the timestamp."""
    elapsed = (ts.cast("timestamp_ntz") - _epoch()).cast("interval second")
    return (elapsed.cast("decimal(18,6)") * 1_000_000).cast("long")


def from_micros(value: Column) -> Column:
    zero = F.lit(0)
    seconds = (value.cast("decimal(18,0)") / 1_000_000).cast("decimal(18,6)")
    return _epoch() + F.make_dt_interval(zero, zero, zero, seconds)


def hours_between(earlier: Column, later: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(float(MICROS_PER_HOUR))


def add_hours(ts: Column, hours: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), hours.cast("int"))


def nearest_step(ts: Column, step_hours: int) -> Column:
    """Nearest multiple of the step; a time half way goes to the later one."""
    half = F.lit(step_hours * MICROS_PER_HOUR // 2)
    steps = F.floor((micros(ts) + half) / F.lit(step_hours * MICROS_PER_HOUR))
    return add_hours(_epoch(), steps * step_hours)


def temporal_features(df: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """Hour and day of year, plain and on the unit circle."""
    hour = F.hour(timestamp)
    day = F.dayofyear(timestamp)
    hour_angle = hour * F.lit(2 * math.pi) / HOURS_PER_DAY
    day_angle = day * F.lit(2 * math.pi) / DAYS_PER_YEAR
    return df.withColumns(
        {
            "hour": hour,
            "day_of_year": day,
            "hour_sin": F.sin(hour_angle),
            "hour_cos": F.cos(hour_angle),
            "day_sin": F.sin(day_angle),
            "day_cos": F.cos(day_angle),
        }
    )
