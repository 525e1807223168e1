"""Wind, pressure and category relations."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower wind bound in knots of each hurricane category.
CATEGORY_BOUNDS = [(1, 64), (2, 83), (3, 96), (4, 113), (5, 137)]

AMBIENT_PRESSURE = 1013.0
WIND_PRESSURE_SCALE = 14.0


def storm_category(wind: Column) -> Column:
    """Hurricane category 1..5, 0 below hurricane force, NULL for a missing wind."""
    category = F.when(wind.isNull(), F.lit(None).cast("int"))
    for number, bound in reversed(CATEGORY_BOUNDS):
        category = category.when(wind >= bound, F.lit(number))
    return category.otherwise(F.lit(0))


def expected_pressure(wind: Column) -> Column:
    scaled = wind / WIND_PRESSURE_SCALE
    return F.lit(AMBIENT_PRESSURE) - scaled * scaled
