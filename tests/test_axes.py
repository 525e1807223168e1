"""Images on grid axes, as-of joins, dense tiles and the pruned layout."""

import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tempestry.operators import asof, axes, patches
from tempestry.plans import training
from tempestry.sources import sinks

T0 = datetime(2023, 9, 5)
GRID = "time timestamp_ntz, latitude double, longitude double, u10 double, msl double"
FIX = "storm_id string, timestamp timestamp_ntz, latitude double, longitude double"


def cells(latitudes, longitudes, times=(T0,)):
    return [(t, la, lo, la * 1000 + lo, float(i)) for i, t in enumerate(times) for la in latitudes for lo in longitudes]


# -- images ------------------------------------------------------------------------------------


def test_columns_count_on_over_the_dateline(spark):
    grid = spark.createDataFrame(cells([1.0, -1.0, 3.0], [174.0, 176.0, 178.0, 180.0, -178.0, -176.0, 0.0, 90.0]), GRID)
    fix = spark.createDataFrame([("A", T0, 0.0, 179.0)], FIX)
    got = patches.patch_images(grid, fix, 10.0).collect()
    assert {r.longitude: r["col"] for r in got} == {174.0: 0, 176.0: 1, 178.0: 2, 180.0: 3, -178.0: 4, -176.0: 5}
    assert {r.latitude: r["row"] for r in got} == {3.0: 0, 1.0: 1, -1.0: 2}
    assert {(r.n_rows, r.n_cols) for r in got} == {(3, 6)}


def plain_image(grid, lat, lon, half):
    """{(row, col): (lat, lon)} by walking the axes from the box's north-west corner."""
    lats = sorted({c[1] for c in grid if lat - half <= c[1] <= lat + half}, reverse=True)
    lons = sorted({c[2] for c in grid if (c[2] - (lon - half)) % 360 <= 2 * half}, key=lambda v: (v - (lon - half)) % 360)
    return {(r, c): (la, lo) for r, la in enumerate(lats) for c, lo in enumerate(lons)}, len(lats), len(lons)


def test_images_equal_brute_force(spark):
    rng = random.Random(2)
    lats = sorted({rng.randrange(-900, 901) / 10 for _ in range(40)})
    lons = sorted({rng.randrange(-1799, 1801) / 10 for _ in range(60)})
    grid = cells(lats, lons)
    centres = [(f"S{i}", T0, float(rng.randint(-80, 80)), rng.randint(-360, 360) / 2) for i in range(25)]
    for size in (8.0, 61.0):
        got = {}
        made = patches.patch_images(spark.createDataFrame(grid, GRID), spark.createDataFrame(centres, FIX), size)
        for r in made.collect():
            got.setdefault(r.storm_id, {})[r["row"], r["col"]] = (r.latitude, r.longitude, r.n_rows, r.n_cols)
        for name, _, lat, lon in centres:
            want, n_rows, n_cols = plain_image(grid, lat, lon, size / 2)
            assert got.get(name, {}) == {k: (*v, n_rows, n_cols) for k, v in want.items()}


def test_images_keep_their_places_where_cells_are_missing(spark):
    whole = cells([0.0, 1.0, 2.0], [0.0, 1.0, 2.0], [T0, T0 + timedelta(hours=6)])
    grid = spark.createDataFrame([c for c in whole if not (c[0] == T0 and c[2] == 0.0)], GRID)
    fixes = spark.createDataFrame([("A", T0, 1.0, 1.0)], FIX)
    got = patches.patch_images(grid, fixes, 2.0, ["u10", "no such"])
    assert sorted((r["row"], r["col"]) for r in got.collect()) == [(r, c) for r in range(3) for c in (1, 2)]
    assert "msl" not in got.columns
    assert patches.patch_images(grid, fixes.limit(0), 2.0).count() == 0
    assert patches.patch_images(grid.limit(0), fixes, 2.0).count() == 0
    lost = spark.createDataFrame([("B", T0, None, 1.0)], FIX)
    assert patches.patch_images(grid, lost, 2.0).count() == 0


def test_tiles_larger_than_two_by_two(spark):
    grid = spark.createDataFrame(cells([float(v) for v in range(6)], [float(v) for v in range(9)]), GRID)
    track = spark.createDataFrame([("A", T0, 2.5, 4.0)], FIX)
    tile = [("A", T0, r, c, 10.0 * r + c) for r in range(3) for c in range(3)]
    tiles = spark.createDataFrame(tile, "storm_id string, time timestamp_ntz, row int, col int, ir double")
    made = training.patch_channels(track, grid, 6, 8.0, ["u10"], tiles=tiles, tile_shape=(3, 3)).collect()
    assert len(made) == 54
    for r in made:
        assert r.channels == [10.0 * (r["row"] // 2) + r["col"] // 3, (5 - r["row"]) * 1000.0 + r["col"]]


def test_images_need_no_window(spark):
    grid = spark.createDataFrame(cells([0.0], [0.0]), GRID)
    fixes = spark.createDataFrame([("A", T0, 0.0, 0.0)], FIX)
    plan = patches.patch_images(grid, fixes, 2.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_places_on_an_axis(spark):
    grid = spark.createDataFrame(cells([90.0, -90.0, 0.25, 0.5], [-180.0, 180.0, 359.0]), GRID)
    table = axes.axis_table(grid)
    edges = spark.createDataFrame([(-200.0,), (-90.0,), (-0.5,), (-0.3,), (90.0,), (500.0,)], "edge double")
    below = axes.with_place(edges, table, "n", axes.ROWS, F.col("edge"))
    upto = axes.with_place(edges, table, "n", axes.ROWS, F.col("edge"), closed=True)
    assert [r.n for r in below.orderBy("edge").collect()] == [0, 0, 1, 2, 3, 4]
    assert [r.n for r in upto.orderBy("edge").collect()] == [0, 1, 2, 2, 4, 4]


# -- as-of joins -------------------------------------------------------------------------------


def plain_asof(t, times, direction, tolerance):
    best = None
    for a in sorted(times):
        gap = abs(a - t)
        if direction == "backward" and a > t or direction == "forward" and a < t:
            continue
        if (tolerance is None or gap <= tolerance) and (best is None or gap < abs(best - t)):
            best = a
    return best


@pytest.mark.parametrize("direction", asof.DIRECTIONS)
@pytest.mark.parametrize("crowd,hours,tolerance", [(64, 24, None), (2, 5, 7.5), (3, 1, 400)])
def test_asof_equals_brute_force(spark, direction, crowd, hours, tolerance):
    rng = random.Random(crowd)
    keys = [None, "a", "b", "c"]
    times = {k: [T0 + timedelta(minutes=rng.choice([rng.randint(0, 60 * 24 * 40), rng.randint(0, 90)])) for _ in range(60)] for k in keys[:3]}
    given = [(rng.choice(keys), T0 + timedelta(minutes=rng.randint(-5000, 70000)), i) for i in range(250)]
    given += [("a", T0 + timedelta(minutes=3), 1000 + i) for i in range(100)] + [("a", None, 2000)]
    left = spark.createDataFrame(given, "basin string, at timestamp_ntz, id int")
    right = spark.createDataFrame([(k, t) for k, ts in times.items() for t in [*ts, ts[0], None]], "basin string, time timestamp_ntz")
    got = asof.asof_join(left, right, "at", "time", "found", ["basin"], direction, tolerance, hours, crowd).collect()
    assert len(got) == len(given)
    limit = None if tolerance is None else timedelta(hours=tolerance)
    for r in got:
        want = None if r["at"] is None else plain_asof(r["at"], times.get(r.basin, []), direction, limit)
        assert r.found == want, (r, want)


def test_asof_prefers_the_earlier_time_and_bounds_what_a_row_meets(spark):
    left = spark.createDataFrame([(T0,)], "at timestamp_ntz")
    right = spark.createDataFrame([(T0 + timedelta(hours=h),) for h in (-2, 2, 5)], "time timestamp_ntz")
    assert asof.asof_join(left, right, "at", "time", "found").first()["found"] == T0 - timedelta(hours=2)
    assert asof.asof_join(left, right.limit(0), "at", "time", "found").first()["found"] is None
    assert asof.asof_join(left.limit(0), right, "at", "time", "found").count() == 0
    with pytest.raises(ValueError):
        asof.asof_join(left, right, "at", "time", "found", direction="sideways")


# -- dense tiles ---------------------------------------------------------------------------------


def test_dense_tiles_are_cut(spark):
    """Nine of ten boxes lie on one place; no part holds many more of them than asked for, and no cell is lost or doubled."""
    grid = spark.createDataFrame(cells([float(v) for v in range(10)], [float(v) for v in range(10)]), GRID)
    fixes = [(f"S{i}", T0, 5.0, 5.0) if i % 10 else (f"S{i}", T0, 60.0, 60.0) for i in range(400)]
    centres = spark.createDataFrame(fixes, FIX)
    boxes = patches.patch_boxes(centres, F.col("timestamp"), 4.0)
    placed, spread, inside, keys = patches.tiled(boxes, grid, 4.0, True, dense=50)
    sizes = [r["count"] for r in placed.groupBy(*keys).count().collect()]
    assert max(sizes) <= 90
    cut = patches.box_join(boxes, grid, 4.0, True, dense=50)
    whole = patches.box_join(boxes, grid, 4.0, True)
    order = ["storm_id", "latitude", "longitude"]
    assert rows(cut.select(order), *order) == rows(whole.select(order), *order)
    assert cut.count() == 360 * 25


# -- pruned layout -------------------------------------------------------------------------------


def test_a_box_is_read_from_few_files(spark, tmp_path):
    times = [T0 + timedelta(hours=6 * i) for i in range(12)]
    lons = [float(v) for v in range(-180, 180, 10)]
    grid = spark.createDataFrame(cells([float(v) for v in range(-80, 81, 10)], lons, times), GRID)
    path = str(tmp_path / "grid")
    sinks.write_pruned_grid(grid, path, 6.0, 40)
    order = ["time", "latitude", "longitude"]
    total = spark.read.parquet(f"{path}/index").count()
    for box in [(10, 30, 20, 50, T0, times[2]), (-20, 0, 170, -160, times[3], times[4]), (85, 89, 0, 10, T0, T0)]:
        south, north, west, east, start, end = box
        across = (F.col("longitude") >= west) & (F.col("longitude") <= east)
        if west > east:
            across = (F.col("longitude") >= west) | (F.col("longitude") <= east)
        want = grid.where(F.col("latitude").between(south, north) & across & F.col("time").between(F.lit(start), F.lit(end)))
        assert rows(sinks.read_box(spark, path, *box), *order) == rows(want, *order)
        assert sinks.box_files(spark, path, *box).count() <= total / 3
    assert rows(spark.read.parquet(f"{path}/cells"), *order) == rows(grid, *order)
