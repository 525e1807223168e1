"""Fixed column layouts shared by every operator."""

from pyspark.sql import types as T

TRACK_SCHEMA = T.StructType(
    [
        T.StructField("storm_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("record_identifier", T.StringType()),
        T.StructField("storm_type", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("max_wind", T.DoubleType()),
        T.StructField("min_pressure", T.DoubleType()),
        T.StructField("r34_ne", T.DoubleType()),
        T.StructField("r34_se", T.DoubleType()),
        T.StructField("r34_sw", T.DoubleType()),
        T.StructField("r34_nw", T.DoubleType()),
    ]
)

# Column names of the published best-track files for the four wind radii.
RADIUS_NAMES = {"r34_ne": "34kt_ne", "r34_se": "34kt_se", "r34_sw": "34kt_sw", "r34_nw": "34kt_nw"}

GRID_COORDS = ["time", "latitude", "longitude"]
GRID_VARIABLES = ["u10", "v10", "msl", "t2m", "d2m", "u200", "v200", "u850", "v850", "sst"]


def with_archive_radius_names(tracks):
    """Rename the radius columns to the names used in published files."""
    return tracks.withColumnsRenamed(
        {ours: theirs for ours, theirs in RADIUS_NAMES.items() if ours in tracks.columns}
    )
