"""Diagnostics, statistics, tensors, patches and conservation."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tempestry.operators import conservation as cv
from tempestry.operators import grid as gr
from tempestry.operators import patches
from tempestry.plans import training

T0 = datetime(2023, 9, 5)
NAMES = ["u10", "v10", "msl", "t2m", "d2m", "u200", "v200", "u850", "v850", "sst"]


@pytest.fixture(scope="module")
def field():
    rng = np.random.default_rng(7)
    lats, lons = np.array([30.0, 28.0, 27.5, 21.0]), np.array([-70.0, -69.0, -66.5, -66.0, -60.0])
    shape = (2, len(lats), len(lons))
    values = {n: rng.normal(size=shape) for n in NAMES}
    values["msl"] = values["msl"] * 500 + 101300
    values["t2m"] = values["t2m"] * 5 + 298
    values["d2m"] = values["d2m"] * 5 + 293
    return lats, lons, values


@pytest.fixture(scope="module")
def cube(spark, field):
    lats, lons, values = field
    data = [
        (T0 + timedelta(hours=t), float(la), float(lo), *[float(values[n][t, i, j]) for n in NAMES])
        for t in range(2) for i, la in enumerate(lats) for j, lo in enumerate(lons)
    ]
    spec = "time timestamp_ntz, latitude double, longitude double, " + ", ".join(f"{n} double" for n in NAMES)
    return spark.createDataFrame(data, spec).cache()


def as_array(df, name, field):
    lats, lons, _values = field
    found = {(r.time, r.latitude, r.longitude): r[name] for r in df.collect()}
    return np.array(
        [[[found[T0 + timedelta(hours=t), la, lo] for lo in lons] for la in lats] for t in range(2)]
    )


def test_derived_fields(cube, field):
    lats, lons, v = field
    made = gr.derived_fields(cube)
    u, w = v["u10"], v["v10"]
    dvdx = np.gradient(w, lons, axis=2)
    dudx, dudy, dvdy = np.gradient(u, lons, axis=2), np.gradient(u, lats, axis=1), np.gradient(w, lats, axis=1)
    tc, td = v["t2m"] - 273.15, v["d2m"] - 273.15
    e = 6.112 * np.exp(17.67 * td / (td + 243.5))
    expected = {
        "wind_speed": np.hypot(u, w),
        "wind_direction": np.degrees(np.arctan2(w, u)),
        "vorticity_10m": dvdx - dudy,
        "convergence_10m": -(dudx + dvdy),
        "theta": v["t2m"] * (1000.0 / v["msl"]) ** (287.0 / 1004.0),
        "vertical_wind_shear": np.hypot(v["u200"] - v["u850"], v["v200"] - v["v850"]),
        "relative_humidity": np.clip(
            100 * np.exp(17.625 * td / (243.04 + td)) / np.exp(17.625 * tc / (243.04 + tc)), 0, 100
        ),
        "dewpoint_depression": v["t2m"] - v["d2m"],
        "specific_humidity": 0.622 * e / (v["msl"] / 100 - 0.378 * e),
    }
    for name, values in expected.items():
        np.testing.assert_allclose(as_array(made, name, field), values, rtol=1e-9, atol=1e-12)
    hpa = gr.grid_thermo(cube, msl_unit="pa")
    np.testing.assert_allclose(
        as_array(hpa, "theta", field), v["t2m"] * (1000 / (v["msl"] / 100)) ** (287 / 1004), rtol=1e-9
    )


def test_absent_inputs_are_skipped(cube):
    bare = cube.select("time", "latitude", "longitude", "u10")
    assert gr.derived_fields(bare).columns == bare.columns


def test_single_point_axis_has_no_slope(cube):
    line = gr.grid_kinematics(cube.filter("latitude = 30.0"))
    assert line.filter(F.col("vorticity_10m").isNotNull()).count() == 0


def test_statistics(cube, field):
    _lats, _lons, v = field
    gappy = cube.withColumn("sst", F.when(F.col("longitude") > -69, F.col("sst")))
    stats = {r.variable: r for r in gr.grid_stats_fit(gappy, ["sst", "u10", "absent"]).collect()}
    assert set(stats) == {"sst", "u10"}
    assert stats["u10"]["std"] == pytest.approx(v["u10"].std())
    assert stats["sst"]["mean"] == pytest.approx(v["sst"][:, :, 2:].mean())
    scaled = gr.grid_zscore(cube, gr.grid_stats_fit(cube, ["u10"]), ["u10", "v10", "absent"])
    np.testing.assert_allclose(
        as_array(scaled, "u10", field), (v["u10"] - v["u10"].mean()) / (v["u10"].std() + 1e-8)
    )
    np.testing.assert_allclose(as_array(scaled, "v10", field), v["v10"])
    with pytest.raises(ValueError):
        gr.grid_stats_fit(cube, ["absent"])


def test_tensor(cube, field):
    _lats, _lons, v = field
    one = gr.grid_to_tensor(cube, ["msl", "u10", "absent"]).filter(F.col("time") == T0).first()
    assert one["variables"] == ["msl", "u10"]
    np.testing.assert_allclose(np.array(one["tensor"]), np.stack([v["msl"][0], v["u10"][0]]), rtol=1e-6)
    with pytest.raises(ValueError):
        gr.grid_to_tensor(cube, ["absent"])


def test_levels_and_merge(spark):
    data = [(T0, 1.0, 2.0, level, level * 1.0, level * 2.0) for level in (200, 850)]
    levels = spark.createDataFrame(
        data, "time timestamp_ntz, latitude double, longitude double, pressure_level int, u double, v double"
    )
    wide = gr.level_pivot(levels, [200, 850])
    assert wide.first().asDict() == {
        "time": T0, "latitude": 1.0, "longitude": 2.0, "u200": 200.0, "v200": 400.0, "u850": 850.0, "v850": 1700.0
    }
    assert gr.level_pivot(levels.drop("v"), [200]).columns == levels.drop("v").columns
    single = spark.createDataFrame(
        [(T0, 1.0, 3.0, 9.0)], "time timestamp_ntz, latitude double, longitude double, msl double"
    )
    assert gr.cube_outer_merge(single, wide).count() == 2
    assert gr.yearly_union([single, wide]).count() == 2


# -- patches -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def world(spark):
    """Global 10 degree grid in -180..170 at one time."""
    steps = F.sequence(F.lit(-18), F.lit(17))
    cells = spark.range(-9, 10).select("id", F.explode(steps).alias("east"))
    return cells.select(
        F.lit(T0).cast("timestamp_ntz").alias("time"),
        (F.col("id") * 10.0).alias("latitude"),
        (F.col("east") * 10.0).alias("longitude"),
        (F.col("east") * 10.0).alias("msl"),
    ).cache()


def brute_force(lat, lon, half):
    found = set()
    for la in range(-90, 91, 10):
        for lo in range(-180, 180, 10):
            if la < lat - half or la > lat + half:
                continue
            if any(lon - half <= lo + turn <= lon + half for turn in (-360, 0, 360)):
                found.add((float(la), float(lo)))
    return found


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    centres=st.lists(
        st.tuples(st.integers(-160, 160).map(lambda v: v / 2), st.integers(-360, 360).map(lambda v: v / 2)),
        min_size=1, max_size=6,
    ),
    patch=st.sampled_from([10.0, 25.0, 60.0, 100.0]),
)
def test_patches_equal_brute_force(spark, world, centres, patch):
    data = [(f"S{i}", T0, lat, lon) for i, (lat, lon) in enumerate(centres)]
    fixes = spark.createDataFrame(data, "storm_id string, timestamp timestamp_ntz, latitude double, longitude double")
    got = {}
    for r in patches.patch_extract(world, fixes, patch).collect():
        cell = (r.latitude, r.longitude)
        assert cell not in got.setdefault(r.storm_id, set())
        got[r.storm_id].add(cell)
    for i, (lat, lon) in enumerate(centres):
        assert got.get(f"S{i}", set()) == brute_force(lat, lon, patch / 2)


def test_patch_on_0_360_grid(spark, world):
    east = world.withColumn("longitude", F.when(F.col("longitude") < 0, F.col("longitude") + 360).otherwise(F.col("longitude")))
    fix = spark.createDataFrame([("A", T0, 0.0, 179.0)], "storm_id string, timestamp timestamp_ntz, latitude double, longitude double")
    got = {r.longitude for r in patches.patch_extract(east, fix, 30.0, ["msl"]).collect()}
    assert got == {170.0, 180.0, -170.0}


def test_dateline_boxes_and_cube(make_tracks, world):
    tracks = make_tracks({"A": [(0, 170), (0, -170)]}, start=T0)
    boxes = {r.side: (r.lon_min, r.lon_max, r.lat_min, r.start_time) for r in patches.storm_boxes(tracks, 10.0).collect()}
    assert boxes == {
        "east": (165.0, 175.0, -5.0, T0 - timedelta(hours=6)),
        "west": (-175.0, -165.0, -5.0, T0 - timedelta(hours=6)),
    }
    cells = patches.storm_cube_extract(world, tracks, 10.0)
    assert sorted((r.side, r.longitude) for r in cells.collect()) == [("east", 170.0), ("west", -170.0)]
    early = make_tracks({"B": [(0, 170)]}, start=T0 + timedelta(hours=7))
    assert patches.storm_cube_extract(world, early, 10.0).count() == 0
    assert patches.storm_cube_extract(world, early, 10.0, lead_hours=8).count() == 1


def test_yearly_parts_equal_the_whole(cube):
    half = cube.filter(F.col("time") == T0)
    rest = cube.filter(F.col("time") != T0)
    order = ["time", "latitude", "longitude"]
    assert rows(gr.yearly_union([half, rest]), *order) == rows(cube, *order)


def test_nearest_hour(make_tracks, world):
    tracks = make_tracks({"A": [(0, 0)] * 4}, hours=3, start=T0 - timedelta(hours=3))
    got = patches.nearest_hour_align(tracks, world, 6).select("timestamp", "analysis_time").collect()
    assert sorted((r.timestamp, r.analysis_time) for r in got) == [
        (T0 - timedelta(hours=3), T0),
        (T0, T0),
    ]


def test_windows_with_channels(spark, make_tracks):
    tracks = make_tracks({s: [(10, 20, i, 1000) for i in range(5)] for s in ("A", "B")}, start=T0)
    cells = [
        (T0 + timedelta(hours=6 * t), la, lo, 1.0, 2.0, 3.0, 4.0)
        for t in range(5) for la in (8.0, 12.0) for lo in (18.0, 22.0)
    ]
    grid = spark.createDataFrame(
        cells, "time timestamp_ntz, latitude double, longitude double, u10 double, v10 double, msl double, sst double"
    )
    made = training.aligned_windows_patches(tracks, grid, 6, 2, 1)
    assert made.select("window_index").distinct().count() == 3
    # 3 windows x 2 storms x 2 places x 4 cells, three tile and four field channels
    assert made.count() == 48
    assert made.first()["channels"] == [0.0, 0.0, 0.0, 1.0, 2.0, 3.0, 4.0]


# -- conservation ------------------------------------------------------------------------------


def pair_table(spark, pred, truth):
    data = [(*map(float, np.atleast_1d(p)), *map(float, np.atleast_1d(t))) for p, t in zip(pred, truth)]
    names = [f"{side}{i}" for side in ("p", "t") for i in range(len(data[0]) // 2)]
    return spark.createDataFrame(data, ", ".join(f"{n} double" for n in names))


def test_losses(spark):
    mass = cv.loss_mass(pair_table(spark, [1, 2, 3, 4], [0, 1, 1, 0]), "p0", "t0").collect()
    assert {(r.loss, r.gradient) for r in mass} == {(64.0, 16.0)}
    momentum = cv.loss_momentum(pair_table(spark, [(1, 2), (3, 4)], [(0, 0), (0, 0)]), ("p0", "p1"), ("t0", "t1"))
    assert {(r.loss, r.gradient_u, r.gradient_v) for r in momentum.collect()} == {(52.0, 8.0, 12.0)}
    kinetic = cv.loss_kinetic(pair_table(spark, [(2, 0), (0, 2)], [(1, 0), (0, 1)]), ("p0", "p1"), ("t0", "t1"))
    assert sorted((r.loss, r.gradient_u, r.gradient_v) for r in kinetic.collect()) == [(2.25, 0, 3), (2.25, 3, 0)]
    mse = cv.loss_mse(pair_table(spark, [1, 3], [0, 0]), "p0", "t0").orderBy("p0").collect()
    assert [(r.loss, r.gradient) for r in mse] == [(5.0, 1.0), (5.0, 3.0)]


def test_conservation_errors(cube):
    fields = cv.with_cell_weight(cube).select(
        "time", "latitude", "longitude", "weight", F.lit(1.2).alias("density"), F.col("u10").alias("u"),
        F.col("v10").alias("v"), F.col("t2m").alias("temperature"), F.lit(10.0).alias("height"),
    )
    same = cv.conservation_errors(fields, fields).first()
    assert (same["mass_error"], same["energy_error"], same["vorticity_error"]) == (0, 0, 0)
    double = fields.withColumns({"density": F.lit(2.4), "u": F.col("u") * 3, "v": F.col("v") * 3})
    changed = cv.conservation_errors(double, fields).first()
    assert changed["mass_error"] == pytest.approx(1.0) and changed["vorticity_error"] == pytest.approx(2.0)
    assert math.isclose(changed["energy_error"], 1.0, rel_tol=1e-3)
