"""Diagnostics of gridded fields.

A wide grid has one row per (time, latitude, longitude) and one column per
variable.  Everything but the spatial derivatives is a row-wise expression.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempestry.functions.geo import known
from tempestry.schema import GRID_COORDS

# Fixed values of the humidity and temperature formulas.
ZERO_CELSIUS = 273.15
MAGNUS_A, MAGNUS_B = 17.625, 243.04
BOLTON_E0, BOLTON_A, BOLTON_B = 6.112, 17.67, 243.5
DRY_AIR_RATIO, VAPOUR_DEFICIT = 0.622, 0.378
REFERENCE_PRESSURE = 1000.0
POISSON = 287.0 / 1004.0
SCALE_GUARD = 1e-8


def _has(grid: DataFrame, *columns: str) -> bool:
    return all(c in grid.columns for c in columns)


def grid_wind(grid: DataFrame) -> DataFrame:
    """10 m wind speed and mathematical direction in degrees."""
    if not _has(grid, "u10", "v10"):
        return grid
    u, v = F.col("u10"), F.col("v10")
    return grid.withColumns(
        {"wind_speed": F.sqrt(u * u + v * v), "wind_direction": F.degrees(F.atan2(v, u))}
    )


def grid_thermo(grid: DataFrame, msl_unit: str = "as_given") -> DataFrame:
    """Potential temperature and humidity measures.

    The potential temperature puts ``msl`` into the formula as it is in the grid;
    ``msl_unit="pa"`` converts it to hPa first.
    """
    out = {}
    t, d, p = F.col("t2m"), F.col("d2m"), F.col("msl")
    if _has(grid, "t2m", "msl"):
        pressure = p / 100.0 if msl_unit == "pa" else p
        out["theta"] = t * F.pow(F.try_divide(F.lit(REFERENCE_PRESSURE), pressure), F.lit(POISSON))
    if _has(grid, "t2m", "d2m"):

        def saturation(kelvin):
            celsius = kelvin - ZERO_CELSIUS
            return F.exp(F.try_divide(F.lit(MAGNUS_A) * celsius, celsius + MAGNUS_B))

        percent = F.try_divide(saturation(d) * 100.0, saturation(t))
        clipped = F.least(F.greatest(percent, F.lit(0.0)), F.lit(100.0))
        out["relative_humidity"] = F.when(percent.isNotNull(), clipped)
        out["dewpoint_depression"] = t - d
    if _has(grid, "d2m", "msl"):
        celsius = d - ZERO_CELSIUS
        vapour = F.exp(F.try_divide(F.lit(BOLTON_A) * celsius, celsius + BOLTON_B)) * BOLTON_E0
        out["specific_humidity"] = F.try_divide(
            vapour * DRY_AIR_RATIO, p / 100.0 - vapour * VAPOUR_DEFICIT
        )
    return grid.withColumns(out) if out else grid


def grid_shear(grid: DataFrame) -> DataFrame:
    """Wind difference between 200 and 850 hPa."""
    if not _has(grid, "u200", "v200", "u850", "v850"):
        return grid
    du = F.col("u200") - F.col("u850")
    dv = F.col("v200") - F.col("v850")
    return grid.withColumns(
        {
            "vertical_wind_shear_u": du,
            "vertical_wind_shear_v": dv,
            "vertical_wind_shear": F.sqrt(du * du + dv * dv),
        }
    )


def _slope(value: str, axis: str, line) -> Column:
    """Derivative along an axis, second order inside and one-sided at the ends.

    Spacing may be uneven.  An axis of one point has no derivative (NULL).
    """
    f, x = F.col(value), F.col(axis)
    f_back, x_back = F.lag(value).over(line), F.lag(axis).over(line)
    f_ahead, x_ahead = F.lead(value).over(line), F.lead(axis).over(line)
    back, ahead = x - x_back, x_ahead - x
    inside = (
        back * back * f_ahead + (ahead * ahead - back * back) * f - ahead * ahead * f_back
    ) / (back * ahead * (ahead + back))
    return (
        F.when(x_back.isNotNull() & x_ahead.isNotNull(), inside)
        .when(x_ahead.isNotNull(), (f_ahead - f) / ahead)
        .when(x_back.isNotNull(), (f - f_back) / back)
    )


def grid_kinematics(grid: DataFrame, u: str = "u10", v: str = "v10", suffix: str = "10m"):
    """Relative vorticity and convergence per degree.

    Each window is one line of the grid, so a group is as long as the axis and no
    longer.  A grid that arrives partitioned by ``time`` needs no exchange for
    either window.
    """
    if not _has(grid, u, v):
        return grid
    eastward = Window.partitionBy("time", "latitude").orderBy("longitude")
    northward = Window.partitionBy("time", "longitude").orderBy("latitude")
    slopes = grid.withColumns(
        {"_tempestry_dudx": _slope(u, "longitude", eastward), "_tempestry_dvdx": _slope(v, "longitude", eastward)}
    ).withColumns(
        {"_tempestry_dudy": _slope(u, "latitude", northward), "_tempestry_dvdy": _slope(v, "latitude", northward)}
    )
    return slopes.withColumns(
        {
            f"vorticity_{suffix}": F.col("_tempestry_dvdx") - F.col("_tempestry_dudy"),
            f"convergence_{suffix}": -(F.col("_tempestry_dudx") + F.col("_tempestry_dvdy")),
        }
    ).drop("_tempestry_dudx", "_tempestry_dvdx", "_tempestry_dudy", "_tempestry_dvdy")


def derived_fields(grid: DataFrame) -> DataFrame:
    """All diagnostics whose inputs are present."""
    return grid_shear(grid_thermo(grid_kinematics(grid_wind(grid))))


def level_pivot(
    levels_grid: DataFrame,
    levels: list[int],
    u: str = "u",
    v: str = "v",
) -> DataFrame:
    """Pressure-level winds to one column per component and level (``u200`` ...).

    The levels are listed, so no extra job has to find them.
    """
    if not _has(levels_grid, u, v):
        return levels_grid
    aggregates = []
    for level in levels:
        at_level = F.col("pressure_level") == level
        aggregates.append(F.max(F.when(at_level, F.col(u))).alias(f"u{level}"))
        aggregates.append(F.max(F.when(at_level, F.col(v))).alias(f"v{level}"))
    return levels_grid.groupBy(*GRID_COORDS).agg(*aggregates)


def cube_outer_merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two cubes on their shared coordinates, missing cells NULL."""
    return left.join(right, GRID_COORDS, "full")


def yearly_union(cubes: list[DataFrame]) -> DataFrame:
    """Cubes of different periods stacked over time."""
    merged = cubes[0]
    for cube in cubes[1:]:
        merged = merged.unionByName(cube, allowMissingColumns=True)
    return merged


# -- statistics --------------------------------------------------------------------------------


def grid_variables(grid: DataFrame) -> list[str]:
    return [c for c in grid.columns if c not in GRID_COORDS]


def grid_stats_fit(grid: DataFrame, variables: list[str] | None = None) -> DataFrame:
    """(variable, mean, std) over all cells and times; missing and NaN cells are left out."""
    present = [v for v in (variables or grid_variables(grid)) if v in grid.columns]
    if not present:
        raise ValueError("none of the variables is in the grid")
    aggregates = []
    for v in present:
        aggregates += [F.avg(known(F.col(v))).alias(f"_tempestry_mean_{v}"), F.stddev_pop(known(F.col(v))).alias(f"_tempestry_std_{v}")]
    entries = [
        F.struct(
            F.lit(v).alias("variable"),
            F.col(f"_tempestry_mean_{v}").alias("mean"),
            F.col(f"_tempestry_std_{v}").alias("std"),
        )
        for v in present
    ]
    return grid.agg(*aggregates).select(F.inline(F.array(*entries)))


def grid_zscore(
    grid: DataFrame, stats: DataFrame | None = None, variables: list[str] | None = None
) -> DataFrame:
    """Scale grid variables with given statistics, or with their own.

    Variables that are not in the grid, or have no statistics, are left alone.  NaN cells become missing.
    """
    present = [v for v in (variables or grid_variables(grid)) if v in grid.columns]
    if stats is None:
        stats = grid_stats_fit(grid, present)
    # one entry per variable of the schema
    entry = F.struct("variable", F.struct("mean", "std"))
    fitted = stats.agg(F.map_from_entries(F.collect_list(entry))).scalar()
    scaled = {}
    for v in present:
        own = F.element_at(F.col("_tempestry_fitted"), F.lit(v))
        z = (known(F.col(v)) - own.getField("mean")) / (own.getField("std") + SCALE_GUARD)
        scaled[v] = F.when(own.isNull(), F.col(v)).otherwise(z)
    return grid.withColumn("_tempestry_fitted", fitted).withColumns(scaled).drop("_tempestry_fitted")


# -- export ------------------------------------------------------------------------------------


def grid_to_tensor(grid: DataFrame, variables: list[str] | None = None) -> DataFrame:
    """One row per time: variable names and a (channel, latitude, longitude) array.

    Rows run north to south and cells west to east.  A row holds one field per
    variable, so its size is set by the grid.
    """
    present = [v for v in (variables or grid_variables(grid)) if v in grid.columns]
    if not present:
        raise ValueError("no valid variables for the tensor")
    cells = [F.col(v).cast("float").alias(v) for v in present]
    lines = grid.groupBy("time", "latitude").agg(
        F.sort_array(F.collect_list(F.struct("longitude", *cells))).alias("_tempestry_cells")
    )
    fields = lines.groupBy("time").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("latitude")).alias("_tempestry_south"), "_tempestry_cells"))).alias(
            "_tempestry_lines"
        )
    )

    def channel(variable):
        return F.transform("_tempestry_lines", lambda line: line["_tempestry_cells"][variable])

    return fields.select(
        "time",
        F.array(*[F.lit(v) for v in present]).alias("variables"),
        F.array(*[channel(v) for v in present]).alias("tensor"),
    )
