"""Planning of extraction requests.

A request is a row (storm_id, start_time, end_time, north, west, south, east,
variables).  Fetching is left to whoever owns the data service; these operators
say what to fetch and what is there already.
"""

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names the data service knows as single-level fields, the default
# pressure-level fields, and their levels.
SINGLE_LEVEL = [
    "10m_u_component_of_wind",
    "10m_v_component_of_wind",
    "mean_sea_level_pressure",
    "2m_temperature",
    "2m_dewpoint_temperature",
    "sea_surface_temperature",
]
PRESSURE_LEVEL = ["u_component_of_wind", "v_component_of_wind"]
LEVELS = ["200", "850"]


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def year_split_periods(requests: DataFrame, last_midnight: bool = False) -> DataFrame:
    """One period per calendar year a request touches.

    A request inside one year stays as it is; otherwise a period ends with its
    year.  ``last_midnight`` ends it at the start of December 31 instead, which
    leaves out that day's hours.
    """
    start, end = F.col("start_time"), F.col("end_time")
    year = F.explode(F.sequence(F.year(start), F.year(end)))
    rows = requests.withColumn("year", year)
    single = F.year(start) == F.year(end)
    first_day = F.make_timestamp_ntz(F.col("year"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    end_of_day = (0, 0, 0) if last_midnight else (23, 59, Decimal("59.999999"))
    last_day = F.make_timestamp_ntz(F.col("year"), F.lit(12), F.lit(31), *[F.lit(x) for x in end_of_day])
    return rows.withColumns(
        {
            "period_start": F.when(single, start).otherwise(F.greatest(start, first_day)),
            "period_end": F.when(single, end).otherwise(F.least(end, last_day)),
        }
    )


def period_day_expand(periods: DataFrame, step_from_start: bool = False) -> DataFrame:
    """Every date that a period touches, with every hour of the day.

    A period that ends before it starts has no dates.  ``step_from_start`` steps 24 h
    from the start's clock time, which can leave out the last date.
    """
    usable = periods.filter(F.col("period_start") <= F.col("period_end"))
    first, last = F.col("period_start"), F.col("period_end")
    if not step_from_start:
        first, last = F.to_date(first), F.to_date(last)
    days = F.sequence(first, last, F.expr("interval 1 day"))
    hours = F.sequence(F.lit(0), F.lit(23))
    return (
        usable.withColumn("_day", F.explode(days))
        .withColumn("date", F.to_date("_day"))
        .withColumn("hour", F.explode(hours))
        .drop("_day")
    )


def variable_routing(
    requests: DataFrame,
    single_level: list[str] | None = None,
    pressure_level: list[str] | None = None,
    levels: list[str] | None = None,
) -> DataFrame:
    """Split requested variables into single-level and pressure-level ones.

    Anything that is not a known single-level name goes to the pressure levels.
    Requests without a list get the defaults.
    """
    known = _texts(SINGLE_LEVEL)
    wanted = F.col("variables")
    single = F.filter(wanted, lambda v: F.array_contains(known, v))
    other = F.filter(wanted, lambda v: ~F.array_contains(known, v))
    default_single = _texts(single_level or SINGLE_LEVEL)
    default_other = _texts(pressure_level or PRESSURE_LEVEL)
    routed = requests.withColumns(
        {
            "single_level": F.when(wanted.isNull(), default_single).otherwise(single),
            "pressure_level": F.when(wanted.isNull(), default_other).otherwise(other),
        }
    )
    none = F.array().cast("array<string>")
    return routed.withColumn(
        "levels", F.when(F.size("pressure_level") > 0, _texts(levels or LEVELS)).otherwise(none)
    )


def extract_key(requests: DataFrame, prefix: str, variables: str = "variables") -> DataFrame:
    """Add the name under which an extract is kept.

    Dates, bounds and a short hash of the variable list; the order of the list
    does not matter.
    """
    dates = F.concat_ws(
        "_", F.date_format("start_time", "yyyyMMdd"), F.date_format("end_time", "yyyyMMdd")
    )
    bounds = F.concat(
        F.col("north").cast("string"),
        F.lit("N_"),
        F.abs("west").cast("string"),
        F.lit("W_"),
        F.col("south").cast("string"),
        F.lit("N_"),
        F.abs("east").cast("string"),
        F.lit("W"),
    )
    listed = F.array_join(F.array_sort(variables), ",")
    digest = F.when(
        F.size(F.coalesce(F.col(variables), F.array().cast("array<string>"))) > 0,
        F.substring(F.md5(listed.cast("binary")), 1, 8),
    ).otherwise(F.lit("default"))
    return requests.withColumn("extract_key", F.concat_ws("_", F.lit(prefix), dates, bounds, digest))


def pending_extracts(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """Requests whose key is not among the existing extracts."""
    return requests.join(existing.select("extract_key"), "extract_key", "left_anti")
