"""Placeholder satellite tiles."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempestry.operators.tracks import storm_bbox

# Default tile sources.
TILE_SOURCES = ["ir1", "ir2", "water_vapor"]


def corner_tiles(
    tracks: DataFrame,
    patch_size: float = 25.0,
    sources: list[str] | None = None,
    fixes: DataFrame | None = None,
) -> DataFrame:
    """Zero-filled 2 x 2 tile per fix at the corners of the storm's padded box.

    Cells carry their row (north first) and column (west first).  The box is that
    of the whole track, also when only some ``fixes`` get tiles.
    """
    box = storm_bbox(tracks, patch_size / 2).drop("start_time", "end_time")
    wanted = tracks if fixes is None else fixes
    corners = (
        wanted.select("storm_id", F.col("timestamp").alias("time"))
        .join(box, "storm_id")
        .select("*", F.posexplode(F.array("lat_max", "lat_min")).alias("row", "latitude"))
        .select("*", F.posexplode(F.array("lon_min", "lon_max")).alias("col", "longitude"))
    )
    zero = F.lit(0.0).cast("float")
    return corners.select(
        "storm_id",
        "time",
        "latitude",
        "longitude",
        "row",
        "col",
        *[zero.alias(s) for s in (sources or TILE_SOURCES)],
    )


def tile_placeholders(
    tracks: DataFrame, patch_size: float = 25.0, sources: list[str] | None = None
) -> DataFrame:
    """Placeholder tiles by time and coordinates."""
    return corner_tiles(tracks, patch_size, sources).drop("row", "col")
