"""Distances and map projections as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
NAUTICAL_MILES_PER_DEGREE = 60.0


def known(value: Column) -> Column:
    """The value, or NULL where it is NaN."""
    return F.when(~F.isnan(value), value)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; the root is clamped so rounding cannot leave asin's domain."""
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    chord = known(F.sin(half_dlat) * F.sin(half_dlat) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.sin(half_dlon) * F.sin(half_dlon))
    # not least(): that would turn a missing position into the longest distance
    # and NaN compares as larger than 1, so it becomes a missing distance first
    clamped = F.when(chord > 1, F.lit(1.0)).otherwise(chord)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(clamped))


def planar_nm(dlat: Column, dlon: Column) -> Column:
    """Flat distance in nautical miles, without narrowing of meridians."""
    return F.sqrt(dlat * dlat + dlon * dlon) * NAUTICAL_MILES_PER_DEGREE


def east_km(lon: Column, reference_lat: Column) -> Column:
    return F.radians(lon) * EARTH_RADIUS_KM * F.cos(F.radians(reference_lat))


def north_km(lat: Column) -> Column:
    return F.radians(lat) * EARTH_RADIUS_KM


def wrap_longitude(lon: Column) -> Column:
    """Bring 0..360 longitudes to -180..180; 180 itself stays."""
    return F.when(lon > 180, lon - 360).when(lon < -180, lon + 360).otherwise(lon)
