"""Forecast tracks: history and forecast of every storm in one table."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempestry.functions.clock import add_hours, hours_between
from tempestry.operators import baselines as bl
from tempestry.operators import quality
from tempestry.operators.ordered import POINT

STATE = ["latitude", "longitude", "max_wind", "min_pressure"]
SMOOTHING_ROWS = 3


def lead_times(tracks: DataFrame, order: str = "timestamp") -> DataFrame:
    """Whole hours since the storm's first fix.

    The first fix comes from a partial aggregate joined back by storm, so a long
    storm is never gathered in one task.
    """
    first = tracks.groupBy("storm_id").agg(F.min(order).alias("_tempestry_first"))
    hours = F.floor(hours_between(F.col("_tempestry_first"), F.col(order)))
    return tracks.join(first, "storm_id").withColumn("lead_time", hours).drop("_tempestry_first")


def forecast_rows(
    tracks: DataFrame,
    forecast_hours: int = 120,
    step_hours: int = 6,
    method: str = "persistence",
    smooth: bool = True,
    order: str = "timestamp",
) -> DataFrame:
    """``forecast_hours // step_hours`` rows per storm after its last fix."""
    steps = forecast_hours // step_hours
    motion = bl.recent_motion(tracks, order, carry=["min_pressure", order, "name"])
    first = tracks.groupBy("storm_id").agg(F.min(order).alias("_tempestry_first"))
    rows = bl.extrapolate(motion, steps, [method], carry=["min_pressure", order, "name"])
    known = F.floor(hours_between(F.col("_tempestry_first"), F.col(order)))
    ahead = F.col("step") * F.lit(step_hours)
    stamped = rows.join(first, "storm_id").select(
        "storm_id",
        "name",
        "step",
        (known + ahead).alias("lead_time"),
        add_hours(F.col(order), ahead).alias(order),
        *STATE,
    )
    return smooth_forecast(stamped) if smooth else stamped


def smooth_forecast(forecast: DataFrame) -> DataFrame:
    """Trailing three-row mean of the positions of forecast rows.

    A group is one storm's forecast, so it has as many rows as there are steps.
    """
    trailing = (
        Window.partitionBy("storm_id")
        .orderBy("lead_time")
        .rowsBetween(-(SMOOTHING_ROWS - 1), Window.currentRow)
    )
    return forecast.withColumns({c: F.avg(c).over(trailing) for c in ("latitude", "longitude")})


def forecast_track(
    tracks: DataFrame,
    forecast_hours: int = 120,
    step_hours: int = 6,
    method: str = "persistence",
    smooth: bool = True,
    order: str = "timestamp",
) -> DataFrame:
    """History and forecast rows with ``lead_time`` and ``is_forecast``.

    Works in the units of the track table throughout.
    """
    past = lead_times(tracks, order).withColumn("is_forecast", F.lit(False))
    future = forecast_rows(tracks, forecast_hours, step_hours, method, smooth, order)
    future = future.drop("step").withColumn("is_forecast", F.lit(True))
    return past.unionByName(future, allowMissingColumns=True).drop(POINT)


def checked_forecast(tracks: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(forecast track, quality verdict per storm over history and forecast)."""
    track = forecast_track(tracks, **options)
    return track, quality.dq_verdict(track)


def position_at_lead(forecast: DataFrame, lead_time: int) -> DataFrame:
    """Position of every storm at a lead time, the first row in time if several."""
    hit = forecast.filter(F.col("lead_time") == lead_time)
    return hit.groupBy("storm_id").agg(
        F.min_by(F.struct("latitude", "longitude"), F.struct("is_forecast", "timestamp")).alias("p")
    ).select("storm_id", "p.latitude", "p.longitude")


def storm_position_at_lead(forecast: DataFrame, storm_id: str, lead_time: int):
    """(latitude, longitude) of one storm; a lead time it lacks is an error."""
    row = position_at_lead(forecast.filter(F.col("storm_id") == storm_id), lead_time).first()
    if row is None:
        raise ValueError(f"lead time {lead_time} is not available")
    return row["latitude"], row["longitude"]


def track_cone(forecast: DataFrame) -> DataFrame:
    return forecast.select("storm_id", "latitude", "longitude")
