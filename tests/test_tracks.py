"""Selections, catalogues, features, windows and normalisation."""

import math
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tempestry.operators import features as ft
from tempestry.operators import tracks as tr
from tempestry.plans import training


@pytest.fixture(scope="module")
def seasons(spark, make_tracks):
    winds = {"AL012022": [40, 65, 70], "AL022022": [30, 35, 40], "AL012023": [60, 70, 80], "AL022023": [20, 25, 45]}
    made = None
    for storm, values in winds.items():
        part = make_tracks(
            {storm: [(10, -50, w, 1000 - w) for w in values]}, start=datetime(int(storm[4:]), 8, 1)
        )
        made = part if made is None else made.unionByName(part)
    return made


def test_training_catalog(seasons):
    got = tr.training_catalog(seasons, [2022, 2023])
    assert [r.storm_id for r in got.orderBy("storm_id").collect()] == ["AL012022", "AL012023"]
    assert tr.training_catalog(seasons, [2022, 2023], 200).count() == 0
    assert tr.training_catalog(seasons, [2021]).count() == 0


def test_storm_over_new_year_counts_in_both_years(make_tracks):
    tracks = make_tracks({"A": [(10, -50, 70, 990)] * 4}, start=datetime(2022, 12, 31, 12))
    got = tr.training_catalog(tracks, [2022, 2023])
    assert sorted(r.year for r in got.collect()) == [2022, 2023]
    assert {r.num_records for r in got.collect()} == {4}


def test_lookups(seasons):
    assert tr.storm_by_id(seasons, "AL012022").count() == 3
    with pytest.raises(Exception, match="storm AL992022 is not in the track table"):
        tr.storm_by_id(seasons, "AL992022").count()
    assert [r.storm_id for r in tr.storms_by_year(seasons, 2023).collect()] == ["AL012023", "AL022023"]
    assert [r.storm_id for r in tr.storms_by_name(seasons, "al01").collect()] == ["AL012022", "AL012023"]
    recent = tr.recent_storms(tr.storm_catalog(seasons), 2023, 1)
    assert [r.storm_id for r in recent.collect()] == ["AL022023"]


def test_years(seasons):
    assert rows(tr.storms_per_year(seasons, [2021, 2022, 2023]), "year") == [(2021, 0), (2022, 2), (2023, 2)]
    activity = tr.year_activity(tr.storms_per_year(seasons)).first()
    assert activity["average_storms"] == 2.0
    assert (activity["most_active_year"], activity["least_active_year"]) == (2022, 2022)


def test_splits(seasons):
    split = tr.storm_list_split(seasons, ["AL012022"], ["AL022022"])
    assert dict(rows(split, "storm_id")) == {
        "AL012022": "train", "AL022022": "validation", "AL012023": "test", "AL022023": "test"
    }
    listed = tr.storm_list_split(seasons, [], ["AL022022"], test=["AL012023"])
    assert dict(rows(listed, "storm_id")) == {"AL022022": "validation", "AL012023": "test"}
    labels = tr.season_split(seasons, {"train": [2022]}).select("split").distinct()
    assert {r.split for r in labels.collect()} == {"train", "unassigned"}


def test_archive_union_prefers_primary(make_tracks):
    first = make_tracks({"A": [(10, 20), (11, 21)]})
    second = make_tracks({"A": [(90, 90), (91, 91), (92, 92)]})
    assert sorted(r.latitude for r in tr.archive_union(first, second).collect()) == [10.0, 11.0, 92.0]
    assert tr.archive_union(first, second, drop_duplicates=False).count() == 5


def test_features_of_one_storm(make_tracks):
    tracks = make_tracks({"A": [(10, 20, 30, 1000), (10.6, 21.2, 65, None), (11.8, 20, 60, 980)]})
    first, second, third = ft.track_features(tracks).orderBy("timestamp").collect()
    assert first["speed"] == first["heading"] == first["wind_change"] == first["rapid_intensification"] == 0
    assert second["lat_velocity"] == pytest.approx(0.1) and second["lon_velocity"] == pytest.approx(0.2)
    assert second["speed"] == pytest.approx(math.hypot(0.1, 0.2))
    assert second["heading"] == pytest.approx(math.degrees(math.atan2(0.2, 0.1)))
    assert second["rapid_intensification"] == 1.0 and second["min_pressure"] == 0
    assert second["lat_acceleration"] == 0 and third["lat_acceleration"] == pytest.approx(0.1)
    assert third["hour"] == 12 and third["hour_sin"] == pytest.approx(0, abs=1e-12)


def test_features_with_real_spacing(make_tracks):
    tracks = make_tracks({"A": [(10, 20), (13, 20), (13, 20)]}, hours=3)
    got = ft.track_features(tracks.drop("max_wind"), use_actual_dt=True).orderBy("timestamp").collect()
    assert [r["lat_velocity"] for r in got] == [0, 1.0, 0]
    assert "wind_change" not in got[0].asDict()
    plain = ft.track_features(tracks, include_temporal=False).orderBy("timestamp").collect()
    assert plain[1]["lat_velocity"] == 0.5 and "hour" not in plain[0].asDict()


def test_zscore_has_unit_sample_deviation(make_tracks):
    tracks = make_tracks({"A": [(15 + i, -45 - 2 * i, 30 + 12 * i, 7.0) for i in range(10)]})
    stats = ft.track_zscore(tracks).agg(
        *[F.avg(c).alias(f"m_{c}") for c in ft.STATE_FEATURES],
        *[F.stddev_samp(c).alias(f"s_{c}") for c in ft.STATE_FEATURES],
    ).first()
    for c in ("latitude", "longitude", "max_wind"):
        assert stats[f"m_{c}"] == pytest.approx(0, abs=1e-9) and stats[f"s_{c}"] == pytest.approx(1)
    assert stats["s_min_pressure"] == 0


def test_zscore_missing_single_and_reuse(make_tracks):
    gappy = make_tracks({"A": [(1, 2, 10, None), (3, 2, None, 900)]})
    got = ft.track_zscore(gappy).orderBy("timestamp").collect()
    assert got[0]["min_pressure"] is None and got[1]["max_wind"] is None
    assert got[1]["latitude"] == pytest.approx(1 * math.sqrt(0.5))
    alone = ft.track_zscore(make_tracks({"A": [(1, 2, 3, 4)]})).first()
    assert alone["latitude"] == 0
    stats = ft.scaler_fit(gappy)
    other = ft.zscore_transform(make_tracks({"B": [(4, 2, 10, 900)]}), stats).first()
    assert other["latitude"] == pytest.approx(2 * math.sqrt(0.5))


def test_sequence_counts(make_tracks):
    tracks = make_tracks({"A": [(i, i, i, i) for i in range(10)], "B": [(0, 0, 0, 0)] * 5})
    windows = ft.sliding_sequences(tracks, 4, 2, ft.STATE_FEATURES)
    assert windows.filter("storm_id = 'A'").count() == 5 and windows.filter("storm_id = 'B'").count() == 0
    last = windows.orderBy(F.col("window_index").desc()).first()
    assert last["window_index"] == 4
    assert [v[0] for v in last["inputs"]] == [4, 5, 6, 7] and [v[0] for v in last["targets"]] == [8, 9]
    with pytest.raises(ValueError):
        ft.sliding_sequences(tracks, 4, 2, ["nothing"])


def test_aligned_windows(make_tracks):
    tracks = make_tracks({"A": [(i, 0, 0, 0) for i in range(5)], "B": [(i, 1, 0, 0) for i in range(7)]})
    windows = ft.aligned_windows(tracks, 2, 1)
    assert rows(windows.groupBy("window_index").count(), "window_index") == [(0, 2), (1, 2), (2, 2)]
    one = windows.first()
    assert len(one["inputs"]) == 2 and len(one["inputs"][0]) == 4 and len(one["targets"]) == 1
    assert ft.common_window_count(tracks.limit(0), 2, 1).first()["n_windows"] == 0


def test_training_sequences(make_tracks):
    tracks = make_tracks({"A": [(15 + i, -45 - i, 30 + i, 1000 - i) for i in range(14)]})
    windows = training.training_sequences(tracks, 8, 4)
    assert windows.count() == 3 and len(windows.first()["inputs"][0]) == len(ft.SEQUENCE_FEATURES)


def test_storm_package(make_tracks):
    tracks = make_tracks({"A": [(10, 20)], "B": [(30, 40)]})
    with pytest.raises(ValueError):
        training.storm_package({"best_track": tracks}, source="elsewhere")
    package = training.storm_package({"best_track": tracks}, storm_ids=["A"], include_tiles=True)
    assert package.grid is None and package.track.count() == 1 and package.tiles.count() == 4


def test_columns_of_any_name_are_kept(make_tracks):
    tracks = make_tracks({"A": [(10 + i, 20 + i, 30 + i, 1000 - i) for i in range(4)]})
    own = {"_number": F.lit(99), "_lat": F.lit("mine"), "_block": F.lit(True), "_before": F.lit(1.5), "_bin": F.lit("x")}
    named = tracks.withColumns(own)
    for made in (ft.haversine_steps(named), ft.track_features(named), tr.history_truth_split(named, 2, 1)):
        assert {tuple(r) for r in made.select(*own).collect()} == {(99, "mine", True, 1.5, "x")}


def test_nan_is_missing_in_scalers(make_tracks):
    tracks = make_tracks({"A": [(10, 20, 30, 1000), (float("nan"), 22, 34, 1004), (14, 24, 38, 1008)]})
    stats = ft.scaler_fit(tracks).first()
    assert stats["latitude_mean"] == 12.0 and stats["n_rows"] == 3
    scaled = [r.latitude for r in ft.track_zscore(tracks).orderBy("timestamp").collect()]
    assert scaled[1] is None and scaled[0] == -scaled[2]
