"""Array-shaped archives: storms with parallel arrays, fields with one array per time."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempestry.operators.tracks import required
from tempestry.schema import GRID_VARIABLES


def _text(df: DataFrame, column: str) -> Column:
    raw = F.col(column)
    if dict(df.dtypes)[column] == "binary":
        raw = F.decode(raw, "UTF-8")
    return F.trim(raw)


def _known(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def explode_storm_arrays(
    archive: DataFrame,
    storm_id: str = "sid",
    name: str = "name",
    time: str = "time",
    lat: str = "lat",
    lon: str = "lon",
    wind: str = "wmo_wind",
    pressure: str = "wmo_pres",
) -> DataFrame:
    """Track rows from one row per storm with parallel arrays.

    Padding is dropped: entries without a time, then rows without a latitude.
    """
    packed = F.arrays_zip(
        *[F.col(c).alias(a) for c, a in ((time, "t"), (lat, "y"), (lon, "x"), (wind, "w"), (pressure, "p"))]
    )
    rows = archive.select(
        _text(archive, storm_id).alias("storm_id"), _text(archive, name).alias("name"), F.inline(packed)
    ).toDF("storm_id", "name", "t", "y", "x", "w", "p")
    return rows.filter(F.col("t").isNotNull()).select(
        "storm_id",
        "name",
        F.col("t").cast("timestamp_ntz").alias("timestamp"),
        _known(F.col("y").cast("double")).alias("latitude"),
        _known(F.col("x").cast("double")).alias("longitude"),
        _known(F.col("w").cast("double")).alias("max_wind"),
        _known(F.col("p").cast("double")).alias("min_pressure"),
    ).filter(F.col("latitude").isNotNull())


def storm_from_arrays(archive: DataFrame, storm: str, storm_id: str = "sid", **columns) -> DataFrame:
    """Track rows of one storm; an unknown id is an error when the plan is run."""
    one = required(archive.filter(_text(archive, storm_id) == storm), f"storm {storm} is not in the archive")
    return explode_storm_arrays(one, storm_id=storm_id, **columns)


def grid_from_arrays(
    fields: DataFrame,
    latitude: Column,
    longitude: Column,
    variables: list[str] | None = None,
) -> DataFrame:
    """Wide grid from rows (time, variable, values), one array of cells per field.

    The arrays of a time are brought side by side before they are exploded, so
    the exchange carries whole fields instead of single cells and the result is
    still partitioned by ``time``.  ``latitude`` and ``longitude`` are expressions
    of the 0-based cell number ``pos``.
    """
    names = variables or GRID_VARIABLES
    wide = fields.groupBy("time").agg(
        *[
            F.first(F.when(F.col("variable") == v, F.col("values")), ignorenulls=True).alias(v)
            for v in names
        ]
    )
    longest = F.greatest(*[F.coalesce(F.size(v), F.lit(0)) for v in names], F.lit(0))
    cells = wide.filter(longest > 0).withColumn(
        "pos", F.explode(F.sequence(F.lit(0), longest - 1))
    )
    return cells.select(
        "time",
        latitude.alias("latitude"),
        longitude.alias("longitude"),
        *[_known(F.get(v, F.col("pos")).cast("double")).alias(v) for v in names],
    )
