"""Statistical baseline forecasts for all storms in one plan.

The motion methods differ only in the factor put on the recent mean motion, so
they share one pass: a storm's last few fixes give its motion, and methods and
steps are literal arrays exploded per storm.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Factor on the mean motion of each method.
MOTION_FACTORS = {"persistence": 0.0, "cliper5": 1.0, "gfs": 1.1, "ecmwf": 0.9}
DEFAULT_BASELINES = ["persistence", "cliper5", "gfs", "ecmwf"]
MOTION_STEPS = 5

Builder = Callable[[DataFrame, int], DataFrame]
_BUILDERS: dict[str, Builder] = {}


def register_baseline(name: str, builder: Builder) -> None:
    """Add a method: ``builder(history, steps)`` returns storm_id, step, position and wind."""
    _BUILDERS[name] = builder


def recent_motion(
    tracks: DataFrame, order: str = "timestamp", carry: list[str] | None = None
) -> DataFrame:
    """Last fix of each storm and its mean displacement over up to five steps.

    The mean of consecutive displacements telescopes to (last - first) / count.
    Only the last six fixes of a storm leave a map task.  ``carry`` names further
    columns of the last fix to keep.
    """
    newest = Window.partitionBy("storm_id").orderBy(F.col(order).desc())
    kept = ["latitude", "longitude", "max_wind", *(carry or [])]
    last = tracks.withColumn("_tempestry_age", F.row_number().over(newest)).filter(
        F.col("_tempestry_age") <= MOTION_STEPS + 1
    )
    per_storm = last.groupBy("storm_id").agg(
        F.min_by(F.struct(*kept), "_tempestry_age").alias("last"),
        F.max_by(F.struct("latitude", "longitude"), "_tempestry_age").alias("_tempestry_first"),
        (F.count(F.lit(1)) - 1).alias("_tempestry_moves"),
    )

    def mean_move(axis):
        total = F.col(f"last.{axis}") - F.col(f"_tempestry_first.{axis}")
        return F.when(F.col("_tempestry_moves") > 0, total / F.col("_tempestry_moves")).otherwise(F.lit(0.0))

    return per_storm.select(
        "storm_id",
        "last",
        mean_move("latitude").alias("lat_move"),
        mean_move("longitude").alias("lon_move"),
    )


def _method_array(names: list[str]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(n).alias("forecast"), F.lit(MOTION_FACTORS[n]).alias("factor"))
            for n in names
        ]
    )


def extrapolate(
    motion: DataFrame, steps: int, methods: list[str], carry: list[str] | None = None
) -> DataFrame:
    """One row per storm, method and step from ``recent_motion`` rows."""
    rows = motion.select("*", F.inline(_method_array(methods))).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(steps)))
    )
    extra = [F.col(f"last.{c}").alias(c) for c in ["max_wind", *(carry or [])]]
    return rows.select(
        "storm_id",
        "forecast",
        "step",
        (F.col("last.latitude") + F.col("lat_move") * F.col("factor") * F.col("step")).alias("latitude"),
        (F.col("last.longitude") + F.col("lon_move") * F.col("factor") * F.col("step")).alias("longitude"),
        *extra,
    )


def baseline_forecasts(
    history: DataFrame,
    steps: int,
    methods: list[str] | None = None,
    order: str = "timestamp",
) -> DataFrame:
    """Forecasts of the named methods; names nobody registered are ignored."""
    names = list(methods or DEFAULT_BASELINES)
    built_in = [n for n in names if n in MOTION_FACTORS and n not in _BUILDERS]
    custom = [n for n in names if n in _BUILDERS]
    if not built_in and not custom:
        raise ValueError(f"no known baseline among {names}")
    parts = []
    if built_in:
        parts.append(extrapolate(recent_motion(history, order), steps, built_in))
    for name in custom:
        forecast = _BUILDERS[name](history, steps).withColumn("forecast", F.lit(name))
        parts.append(
            forecast.select("storm_id", "forecast", "step", "latitude", "longitude", "max_wind")
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
