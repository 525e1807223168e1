import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tempestry.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.default.parallelism": "4",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


TRACK = (
    "storm_id string, name string, timestamp timestamp_ntz, latitude double, longitude double,"
    " max_wind double, min_pressure double"
)


@pytest.fixture(scope="session")
def make_tracks(spark):
    """Track table from {storm: [(lat, lon, wind, pressure), ...]} at six-hour steps."""

    def make(storms, hours=6, start=datetime(2023, 9, 5)):
        rows = []
        for storm, fixes in storms.items():
            for i, fix in enumerate(fixes):
                lat, lon, wind, pressure = (*fix, None, None)[:4]
                when = start + timedelta(hours=hours * i)
                rows.append((storm, storm[:4], when, _f(lat), _f(lon), _f(wind), _f(pressure)))
        return spark.createDataFrame(rows, TRACK)

    return make


def _f(value):
    return None if value is None else float(value)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]
