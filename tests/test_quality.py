"""Quality reports on small tracks and grids with known faults."""

from datetime import datetime

import pytest

from tempestry.operators import quality as dq

GOOD = [(15.0, -45.0, 30, 1008), (15.5, -45.5, 35, 1006), (16.0, -46.0, 35, 1005), (16.5, -46.5, 40, 1003)]


def report(df):
    return {(r.storm_id, r.rule): (r.n_violations, r.is_valid) for r in df.collect()}


def test_clean_track(make_tracks):
    tracks = make_tracks({"A": GOOD})
    for check in (dq.dq_bounds, dq.dq_track, dq.dq_wind_pressure, dq.dq_intensification, dq.dq_continuity):
        assert all(valid for _n, valid in report(check(tracks)).values())
    verdict = dq.dq_verdict(tracks, strict=True).first()
    assert verdict["is_valid"]


def test_bad_latitude_and_short_track(make_tracks):
    tracks = make_tracks({"A": [(200, 0, 10), (200, 1, 10), (None, 2, 10)]})
    assert report(dq.dq_bounds(tracks))["A", "latitude_bounds"] == (2, False)
    found = report(dq.dq_track(tracks))
    assert found["A", "short_track"] == (1, False) and found["A", "missing_coordinates"] == (1, False)


def test_inconsistent_intensity(make_tracks):
    tracks = make_tracks({"A": [(10, 20, 150, 1000), (10, 20, 150, None), (10, 20, 150, 1000), (10, 20, 150, 1000)]})
    assert report(dq.dq_wind_pressure(tracks))["A", "wind_pressure"] == (3, False)
    assert dq.dq_verdict(tracks).first()["is_valid"]
    assert not dq.dq_verdict(tracks, strict=True).first()["is_valid"]


def test_gap_jump_and_speed(make_tracks):
    tracks = make_tracks({"A": [(0, 0), (0, 10), (0, 10.5), (0, 11)]}, hours=13)
    assert report(dq.dq_continuity(tracks)) == {("A", "time_gap"): (3, False), ("A", "position_jump"): (1, False)}
    loose, strict = report(dq.dq_track(tracks)), report(dq.dq_track(tracks, strict=True))
    assert loose["A", "time_gap"] == (3, True) and strict["A", "time_gap"] == (3, False)
    fast = make_tracks({"A": [(0, 0), (0, 8), (0, 8), (0, 8)]})
    assert report(dq.dq_track(fast))["A", "motion_speed"] == (1, False)


def test_no_time_between_fixes(make_tracks):
    tracks = make_tracks({"A": [(0, 0, 10, 1000), (0, 1, 20, 1000), (0, 1, 20, 1000), (0, 1, 15, 1000)]}, hours=0)
    tracks = tracks.withColumn("point", tracks.longitude.cast("long") * 0 + 1)
    # rows at one instant: any movement or gain is a violation, none is not
    checked = dq.track_checks(tracks.drop("point"), ["motion_speed", "intensification_rate"]).first()
    assert checked["motion_speed"] >= 1 and checked["intensification_rate"] >= 1


def test_rapid_gain(make_tracks):
    gain = make_tracks({"A": [(0, 0, 10, 1010), (0, 0, 36, 1005), (0, 0, 60, 995), (0, 0, 60, 995)]})
    assert report(dq.dq_intensification(gain))["A", "intensification_rate"] == (1, False)


def test_columns(make_tracks):
    tracks = make_tracks({"A": GOOD})
    with pytest.raises(ValueError):
        dq.dq_track(tracks.drop("latitude"))
    bare = tracks.drop("max_wind", "min_pressure")
    assert set(r.rule for r in dq.dq_bounds(bare).collect()) == {"latitude_bounds", "longitude_bounds"}
    assert dq.dq_verdict(bare).first()["physics_valid"]


def test_messages(make_tracks):
    tracks = make_tracks({"A": GOOD[:2]})
    messages = [r.message for r in dq.describe(dq.dq_track(tracks)).collect()]
    assert messages == ["1 violation(s) of short_track"]


def test_grid(spark):
    cells = [(datetime(2023, 1, 1), 95.0 if i == 0 else 10.0, float(i), 1.0, 1.0, None if i < 2 else 1.0) for i in range(10)]
    grid = spark.createDataFrame(cells, "time timestamp_ntz, latitude double, longitude double, u10 double, v10 double, msl double")
    found = {(r.rule, r.subject): (r.value, r.is_valid) for r in dq.dq_grid(grid).collect()}
    assert found["required_variable", "t2m"] == (0.0, False)
    assert found["missing_share", "msl"] == (20.0, False) and found["missing_share", "u10"] == (0.0, True)
    assert found["range_high", "latitude"] == (95.0, False) and found["range_high", "longitude"] == (9.0, True)
    missing = {(r.rule, r.subject): r.is_valid for r in dq.dq_grid(grid.drop("time")).collect()}
    assert not missing["required_dimension", "time"]


def test_grid_columns_of_any_type(spark):
    grid = spark.createDataFrame(
        [(datetime(2023, 9, 5), 1.0, 2.0, "a", None, float("nan"), 3), (datetime(2023, 9, 5), 1.0, 3.0, None, None, 1.0, None)],
        "time timestamp_ntz, latitude double, longitude double, note string, day date, u10 float, n int",
    )
    shares = {r.subject: r.value for r in dq.dq_grid(grid).collect() if r.rule == "missing_share"}
    assert shares == {"note": 50.0, "day": 100.0, "u10": 50.0, "n": 50.0}
