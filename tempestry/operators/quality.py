"""Data-quality reports against physical limits, for all storms in one pass.

Reports are long: one row per storm and rule with the number of violations.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempestry.functions.clock import hours_between
from tempestry.functions.geo import known, planar_nm
from tempestry.functions.intensity import expected_pressure
from tempestry.operators import ordered

KEY = ["storm_id"]


@dataclass(frozen=True)
class Limits:
    """Default physical limits of a track."""

    max_abs_latitude: float = 60.0
    max_abs_longitude: float = 180.0
    max_wind: float = 200.0
    min_pressure: float = 850.0
    max_pressure: float = 1050.0
    max_motion_kt: float = 70.0
    min_points: int = 4
    max_gap_hours: float = 12.0
    max_jump_nm: float = 500.0
    pressure_tolerance: float = 50.0
    max_rate_kt_per_hour: float = 2 * 50.0 / 24.0


DEFAULT_LIMITS = Limits()

BOUNDS_RULES = [
    "latitude_bounds",
    "longitude_bounds",
    "wind_high",
    "wind_negative",
    "pressure_low",
    "pressure_high",
]
TRACK_RULES = ["missing_coordinates", "short_track", "time_gap", "motion_speed"]
PHYSICS_RULES = ["wind_pressure", "intensification_rate"]
CONTINUITY_RULES = ["time_gap", "position_jump"]
STEPWISE_RULES = {"time_gap", "motion_speed", "position_jump", "intensification_rate"}

REQUIRED_TRACK_COLUMNS = ["timestamp", "latitude", "longitude"]
REQUIRED_GRID_VARIABLES = ["u10", "v10", "msl", "t2m"]
GRID_DIMENSIONS = ["time", "latitude", "longitude"]


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def _exceeds(amount: Column, hours: Column, limit: float) -> Column:
    """amount/hours > limit, where no elapsed time makes any amount a violation."""
    return F.when(hours == 0, amount > 0).otherwise(F.try_divide(amount, hours) > limit)


def check_required_columns(tracks: DataFrame) -> None:
    missing = [c for c in REQUIRED_TRACK_COLUMNS if c not in tracks.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def track_checks(
    tracks: DataFrame,
    rules: list[str],
    limits: Limits = DEFAULT_LIMITS,
    order: str = "timestamp",
    block_rows: int = ordered.BLOCK_ROWS,
    numbered: str | None = None,
) -> DataFrame:
    """Wide report: one row per storm, one violation count per rule.

    ``numbered`` names a dense row number per storm, if there is one.  Only rules about consecutive fixes need rows in order.  Without them the
    report is a plain aggregate with map-side partial counts.
    """
    check_required_columns(tracks)
    has_wind = "max_wind" in tracks.columns
    has_pressure = "min_pressure" in tracks.columns
    measured = ("latitude", "longitude", "max_wind", "min_pressure")
    tracks = tracks.withColumns({c: known(F.col(c)) for c in measured if c in tracks.columns})
    lat, lon = F.col("latitude"), F.col("longitude")
    wind, pressure = F.col("max_wind"), F.col("min_pressure")

    counts = {
        "latitude_bounds": _count(F.abs(lat) > limits.max_abs_latitude),
        "longitude_bounds": _count(F.abs(lon) > limits.max_abs_longitude),
        "missing_coordinates": _count(lat.isNull() | lon.isNull()),
        "short_track": F.when(F.count(F.lit(1)) < limits.min_points, 1).otherwise(0).cast("long"),
    }
    if has_wind:
        counts["wind_high"] = _count(wind > limits.max_wind)
        counts["wind_negative"] = _count(wind < 0)
    if has_pressure:
        counts["pressure_low"] = _count(pressure < limits.min_pressure)
        counts["pressure_high"] = _count(pressure > limits.max_pressure)
    if has_wind and has_pressure:
        off = F.abs(pressure - expected_pressure(wind))
        counts["wind_pressure"] = _count(off > limits.pressure_tolerance)

    rows = tracks
    if any(rule in STEPWISE_RULES for rule in rules):
        points = ordered.with_points(tracks, KEY, order, numbered)
        blocked = ordered.blocks(points, ordered.NUMBER, before=1, size=block_rows)
        over = ordered.run_window(KEY, ordered.NUMBER)
        lagged = {f"_tempestry_prev_{c}": F.lag(c).over(over) for c in [order, "latitude", "longitude"]}
        if has_wind:
            lagged["_tempestry_prev_wind"] = F.lag("max_wind").over(over)
        rows = ordered.settle(blocked.withColumns(lagged))
        hours = hours_between(F.col(f"_tempestry_prev_{order}"), F.col(order))
        moved = planar_nm(lat - F.col("_tempestry_prev_latitude"), lon - F.col("_tempestry_prev_longitude"))
        counts["time_gap"] = _count(hours > limits.max_gap_hours)
        counts["motion_speed"] = _count(_exceeds(moved, hours, limits.max_motion_kt))
        counts["position_jump"] = _count(moved > limits.max_jump_nm)
        # as everywhere else, physics is checked only where both intensities exist
        if has_wind and has_pressure:
            gain = wind - F.col("_tempestry_prev_wind")
            counts["intensification_rate"] = _count(
                _exceeds(gain, hours, limits.max_rate_kt_per_hour)
            )
    chosen = [counts[r].alias(r) for r in rules if r in counts]
    return rows.groupBy(*KEY).agg(*chosen)


def to_report(wide: DataFrame, ignored: list[str] | None = None) -> DataFrame:
    """Long form; rules in ``ignored`` are counted but do not make a storm invalid."""
    rules = [c for c in wide.columns if c not in KEY]
    long = wide.unpivot(KEY, rules, "rule", "n_violations")
    valid = F.col("n_violations") == 0
    if ignored:
        valid = valid | F.col("rule").isin(ignored)
    return long.withColumn("is_valid", valid)


def dq_bounds(tracks, limits=DEFAULT_LIMITS):
    return to_report(track_checks(tracks, BOUNDS_RULES, limits))


def dq_track(tracks, limits=DEFAULT_LIMITS, strict=False, **options):
    """Missing positions, track length, time gaps (strict only) and implied speed."""
    wide = track_checks(tracks, TRACK_RULES, limits, **options)
    return to_report(wide, [] if strict else ["time_gap"])


def dq_wind_pressure(tracks, limits=DEFAULT_LIMITS):
    return to_report(track_checks(tracks, ["wind_pressure"], limits))


def dq_intensification(tracks, limits=DEFAULT_LIMITS, **options):
    return to_report(track_checks(tracks, ["intensification_rate"], limits, **options))


def dq_continuity(tracks, limits=DEFAULT_LIMITS, **options):
    return to_report(track_checks(tracks, CONTINUITY_RULES, limits, **options))


def describe(report: DataFrame) -> DataFrame:
    """One message per failed rule."""
    text = F.concat_ws(" ", F.col("n_violations").cast("string"), F.lit("violation(s) of"), "rule")
    return report.filter(~F.col("is_valid")).withColumn("message", text)


def dq_grid(
    grid: DataFrame, required: list[str] | None = None, max_missing_percent: float = 10.0
) -> DataFrame:
    """Report (rule, subject, value, is_valid) of a wide grid.

    Required variables and dimensions are known from the schema; missing shares
    and coordinate ranges come from one aggregate over the grid.
    """
    variables = [c for c in grid.columns if c not in GRID_DIMENSIONS]
    needed = [(v, "required_variable") for v in (required or REQUIRED_GRID_VARIABLES)]
    needed += [(d, "required_dimension") for d in GRID_DIMENSIONS]

    aggregates = [F.count(F.lit(1)).alias("_tempestry_cells")]
    kinds = dict(grid.dtypes)
    for v in variables:
        # only floating numbers can be NaN; other columns are of any type
        gone = F.col(v).isNull() | F.isnan(v) if kinds[v] in ("float", "double") else F.col(v).isNull()
        aggregates.append(F.count(F.when(gone, 1)).alias(f"_tempestry_missing_{v}"))
    for axis in ("latitude", "longitude"):
        if axis in grid.columns:
            aggregates += [F.min(axis).alias(f"_tempestry_min_{axis}"), F.max(axis).alias(f"_tempestry_max_{axis}")]
    facts = grid.agg(*aggregates)

    def entry(rule, subject, value, valid):
        return F.struct(
            F.lit(rule).alias("rule"),
            F.lit(subject).alias("subject"),
            value.cast("double").alias("value"),
            valid.alias("is_valid"),
        )

    entries = [
        entry(rule, name, F.lit(1.0 if name in grid.columns else 0.0), F.lit(name in grid.columns))
        for name, rule in needed
    ]
    for v in variables:
        share = F.coalesce(F.try_divide(F.col(f"_tempestry_missing_{v}") * 100.0, F.col("_tempestry_cells")), F.lit(0.0))
        entries.append(entry("missing_share", v, share, share <= max_missing_percent))
    for axis, low, high in (("latitude", -90.0, 90.0), ("longitude", -180.0, 360.0)):
        if axis in grid.columns:
            smallest, largest = F.col(f"_tempestry_min_{axis}"), F.col(f"_tempestry_max_{axis}")
            entries.append(entry("range_low", axis, smallest, smallest >= low))
            entries.append(entry("range_high", axis, largest, largest <= high))
    return facts.select(F.inline(F.array(*entries)))


def dq_verdict(
    tracks: DataFrame,
    grid: DataFrame | None = None,
    strict: bool = False,
    limits: Limits = DEFAULT_LIMITS,
    **options,
) -> DataFrame:
    """Per storm: track, physics and grid validity and whether the storm is usable.

    Track and grid faults always count, physics faults only in strict mode.
    """
    hard = BOUNDS_RULES + TRACK_RULES
    checked = track_checks(tracks, hard + PHYSICS_RULES, limits, **options)

    def clean(rules):
        total = F.lit(0).cast("long")
        for rule in rules:
            if rule in checked.columns:
                total = total + F.col(rule)
        return total == 0

    counted = hard if strict else [r for r in hard if r != "time_gap"]
    grid_valid = F.lit(True)
    if grid is not None:
        grid_valid = dq_grid(grid).agg(F.min(F.col("is_valid"))).scalar()
    verdict = checked.select(
        *KEY,
        clean(counted).alias("track_valid"),
        clean(PHYSICS_RULES).alias("physics_valid"),
        grid_valid.alias("grid_valid"),
    )
    usable = F.col("track_valid") & F.col("grid_valid")
    if strict:
        usable = usable & F.col("physics_valid")
    return verdict.withColumn("is_valid", usable)
