"""Time-series features, normalisation and sliding windows of tracks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempestry.functions.clock import hours_between, temporal_features
from tempestry.functions.geo import haversine_km, known
from tempestry.operators import ordered

FIX_INTERVAL_HOURS = 6.0
RAPID_INTENSIFICATION_KT = 30.0

# Default feature order of the training sequences.
SEQUENCE_FEATURES = [
    "latitude",
    "longitude",
    "max_wind",
    "min_pressure",
    "lat_velocity",
    "lon_velocity",
    "speed",
    "hour_sin",
    "hour_cos",
    "day_sin",
    "day_cos",
]
STATE_FEATURES = ["latitude", "longitude", "max_wind", "min_pressure"]

KEY = ["storm_id"]


def track_features(
    tracks: DataFrame,
    include_temporal: bool = True,
    use_actual_dt: bool = False,
    order: str = "timestamp",
    block_rows: int = ordered.BLOCK_ROWS,
    numbered: str | None = None,
) -> DataFrame:
    """Motion, acceleration, intensity change, heading and calendar features.

    Velocities divide by six hours whatever the spacing of the fixes; with
    ``use_actual_dt`` by the real time between them.  Missing values of numeric
    columns, the original ones included, become 0.  ``numbered`` names a dense
    row number per storm, if there is one.
    """
    points = ordered.with_points(tracks, KEY, order, numbered)
    blocked = ordered.blocks(points, ordered.NUMBER, before=2, size=block_rows)
    over = ordered.run_window(KEY, ordered.NUMBER)

    def back(column, rows):
        return F.lag(column, rows).over(over)

    needed = ["latitude", "longitude"]
    if use_actual_dt:
        needed.append(order)
    lagged = {f"_tempestry_{c}_{n}": back(c, n) for c in needed for n in (1, 2)}
    if "max_wind" in tracks.columns:
        lagged["_tempestry_max_wind_1"] = back("max_wind", 1)
        lagged["_tempestry_min_pressure_1"] = back("min_pressure", 1)
    rows = blocked.withColumns(lagged)

    def rate(now, then, t_now, t_then):
        if not use_actual_dt:
            return (F.col(now) - F.col(then)) / FIX_INTERVAL_HOURS
        gap = hours_between(F.col(t_then), F.col(t_now))
        return F.try_divide(F.col(now) - F.col(then), gap)

    out = {}
    for axis, column in (("lat", "latitude"), ("lon", "longitude")):
        velocity = rate(column, f"_tempestry_{column}_1", order, f"_tempestry_{order}_1")
        previous = rate(f"_tempestry_{column}_1", f"_tempestry_{column}_2", f"_tempestry_{order}_1", f"_tempestry_{order}_2")
        out[f"{axis}_velocity"] = velocity
        out[f"{axis}_acceleration"] = velocity - previous
    lat_v, lon_v = out["lat_velocity"], out["lon_velocity"]
    out["speed"] = F.sqrt(lat_v * lat_v + lon_v * lon_v)
    out["heading"] = F.degrees(F.atan2(lon_v, lat_v))
    if "max_wind" in tracks.columns:
        change = F.col("max_wind") - F.col("_tempestry_max_wind_1")
        out["wind_change"] = change
        out["pressure_change"] = F.col("min_pressure") - F.col("_tempestry_min_pressure_1")
        out["rapid_intensification"] = F.when(
            change >= RAPID_INTENSIFICATION_KT, F.lit(1.0)
        ).otherwise(F.lit(0.0))

    features = ordered.settle(rows.withColumns(out)).select(*tracks.columns, *out)
    if include_temporal:
        features = temporal_features(features, order)
    return features.fillna(0)


def haversine_steps(
    tracks: DataFrame, order: str = "timestamp", block_rows: int = ordered.BLOCK_ROWS, numbered: str | None = None
) -> DataFrame:
    """Great-circle distance from the previous fix; NULL on the first."""
    points = ordered.with_points(tracks, KEY, order, numbered)
    blocked = ordered.blocks(points, ordered.NUMBER, before=1, size=block_rows)
    over = ordered.run_window(KEY, ordered.NUMBER)
    rows = blocked.withColumns(
        {"_tempestry_lat": F.lag("latitude").over(over), "_tempestry_lon": F.lag("longitude").over(over)}
    )
    distance = haversine_km(F.col("_tempestry_lat"), F.col("_tempestry_lon"), F.col("latitude"), F.col("longitude"))
    return ordered.settle(rows.withColumn("step_km", distance)).select(*tracks.columns, "step_km")


# -- normalisation ---------------------------------------------------------------------------


def scaler_columns(df: DataFrame) -> list[str]:
    """Columns to scale: positions, and both intensities when there is a wind."""
    return STATE_FEATURES if "max_wind" in df.columns else STATE_FEATURES[:2]


def scaler_fit(tracks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean and population deviation of values that are neither missing nor NaN, and the row count."""
    stats = [F.count(F.lit(1)).alias("n_rows")]
    for column in scaler_columns(tracks):
        value = known(F.col(column).cast("double"))
        stats.append(F.avg(value).alias(f"{column}_mean"))
        stats.append(F.stddev_pop(value).alias(f"{column}_std"))
    return tracks.groupBy(*(by or [])).agg(*stats)


def zscore_transform(df: DataFrame, stats: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Scale with fitted statistics, from the same or from other data.

    The population z-score times sqrt((N-1)/N), N being the fitted row count, so
    that complete data gets a sample deviation of 1.  A constant column gives 0, a NaN a missing value.
    """
    if by:
        joined = df.join(stats, by)
        fitted = {c: F.col(c) for c in stats.columns}
    else:
        joined = df.withColumn("_tempestry_fitted", stats.select(F.struct("*")).scalar())
        fitted = {c: F.col(f"_tempestry_fitted.{c}") for c in stats.columns}
    n = fitted["n_rows"]
    factor = F.when(n > 1, F.sqrt((n - 1) / n)).otherwise(F.lit(1.0))
    scaled = {}
    for column in scaler_columns(df):
        deviation = fitted[f"{column}_std"]
        divisor = F.when(deviation == 0, F.lit(1.0)).otherwise(deviation)
        scaled[column] = (known(F.col(column).cast("double")) - fitted[f"{column}_mean"]) / divisor * factor
    return joined.withColumns(scaled).select(*df.columns)


def track_zscore(tracks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Fit on the rows themselves and scale them; ``by`` fits each group apart."""
    return zscore_transform(tracks, scaler_fit(tracks, by), by)


# -- windows of consecutive fixes --------------------------------------------------------------


def sliding_sequences(
    df: DataFrame,
    sequence_length: int = 8,
    forecast_length: int = 20,
    features: list[str] | None = None,
    order: str = "timestamp",
    block_rows: int = ordered.BLOCK_ROWS,
    numbered: str | None = None,
) -> DataFrame:
    """Every run of ``sequence_length`` input fixes and the targets right after it.

    One row per window: storm, 0-based window index, inputs and targets as arrays
    of feature arrays.  Storms shorter than one window give no row.  ``numbered`` names
    a dense row number per storm, if there is one.
    """
    wanted = [c for c in (features or SEQUENCE_FEATURES) if c in df.columns]
    if not wanted:
        raise ValueError("none of the feature columns is in the table")
    length = sequence_length + forecast_length
    points = ordered.with_points(df, KEY, order, numbered)
    narrow = points.select(
        *KEY, ordered.NUMBER, F.array(*[F.col(c).cast("double") for c in wanted]).alias("_tempestry_features")
    )
    blocked = ordered.blocks(narrow, ordered.NUMBER, after=length - 1, size=block_rows)
    ahead = ordered.run_window(KEY, ordered.NUMBER).rowsBetween(0, length - 1)
    rows = blocked.withColumn("_tempestry_run", F.collect_list("_tempestry_features").over(ahead))
    return ordered.settle(rows).filter(F.size("_tempestry_run") == length).select(
        *KEY,
        (F.col(ordered.NUMBER) - 1).alias("window_index"),
        F.slice("_tempestry_run", 1, sequence_length).alias("inputs"),
        F.slice("_tempestry_run", sequence_length + 1, forecast_length).alias("targets"),
    )


def common_window_count(
    tracks: DataFrame, sequence_length: int = 1, forecast_length: int = 1
) -> DataFrame:
    """Number of windows that every storm can fill."""
    length = sequence_length + forecast_length
    per_storm = tracks.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_tempestry_rows"))
    fits = F.greatest(F.col("_tempestry_rows") - F.lit(length) + 1, F.lit(0))
    return per_storm.agg(F.coalesce(F.min(fits), F.lit(0)).alias("n_windows"))


def aligned_windows(
    tracks: DataFrame,
    sequence_length: int = 1,
    forecast_length: int = 1,
    order: str = "timestamp",
    block_rows: int = ordered.BLOCK_ROWS,
    numbered: str | None = None,
) -> DataFrame:
    """Windows that all storms share, one row per (window index, storm).

    A training batch is the set of rows of one window index.  It stays a set of
    rows: stacking all storms of an index into one value would grow with the
    number of storms.
    """
    kept = shared_fixes(tracks, sequence_length, forecast_length, order, numbered)
    return sliding_sequences(
        kept, sequence_length, forecast_length, STATE_FEATURES, order, block_rows, ordered.NUMBER
    )


def shared_fixes(
    tracks: DataFrame, sequence_length: int, forecast_length: int, order: str = "timestamp", numbered: str | None = None
) -> DataFrame:
    """Numbered fixes that the shared windows reach; later ones are in no such window."""
    shared = common_window_count(tracks, sequence_length, forecast_length).scalar()
    reach = shared + sequence_length + forecast_length - 1
    return ordered.with_points(tracks, KEY, order, numbered).filter(F.col(ordered.NUMBER) <= reach)
