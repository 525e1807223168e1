"""Numbering and neighbour windows under skew, against plain windows."""

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from tempestry.operators import asof, ensembles, features, ordered, patches, quality
from tempestry.operators.tracks import history_truth_split
from tempestry.plans import training


@pytest.fixture(scope="module")
def skewed(spark):
    """6000 rows, a third of them in key 0, unevenly spread in time and with ties."""
    n = 6000
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97)
    minutes = F.floor(F.pow(F.col("id") * 7919 % n, F.lit(1.4)) / 3).cast("int")
    return (
        spark.range(n)
        .select("id", key.alias("key"), minutes.alias("minutes"), (F.col("id") * 31 % 101).alias("v"))
        .withColumn(
            "ts",
            F.lit("2024-03-09 20:00:00").cast("timestamp_ntz")
            + F.make_dt_interval(F.lit(0), F.lit(0), F.col("minutes")),
        )
        .cache()
    )


def plain_window():
    return Window.partitionBy("key").orderBy("ts", "id")


@pytest.mark.parametrize("min_rows", [5, 100, 3000])
def test_position_of_hot_keys_equals_row_number(skewed, min_rows):
    numbered = ordered.with_position(skewed, ["key"], "ts", ["id"], min_rows=min_rows)
    plain = skewed.withColumn("point", F.row_number().over(plain_window()).cast("long"))
    assert rows(numbered.select("id", "point"), "id") == rows(plain.select("id", "point"), "id")


def test_position_by_number_column(skewed):
    numbered = ordered.with_position(skewed, ["key"], "v", ["id"], min_rows=10)
    over = Window.partitionBy("key").orderBy("v", "id")
    plain = skewed.withColumn("point", F.row_number().over(over).cast("long"))
    assert rows(numbered.select("id", "point"), "id") == rows(plain.select("id", "point"), "id")


def test_position_with_missing_keys_and_odd_values(spark):
    """Large keys may be missing, and their order values missing, infinite or NaN."""
    values = [None, float("nan"), float("inf"), float("-inf"), *(float(i * 37 % 101) for i in range(300))]
    data = [(k, i, v) for k in (None, "a") for i, v in enumerate(values)] + [("b", 1, 2.0), ("c", 1, 3.0), ("c", 2, 3.0)]
    df = spark.createDataFrame(data, "k string, id int, v double")
    over = Window.partitionBy("k").orderBy("v", "id")
    plain = df.withColumn("point", F.row_number().over(over).cast("long"))
    got = ordered.with_position(df, ["k"], "v", ["id"], min_rows=20)
    assert rows(got.drop("v"), "k", "id") == rows(plain.drop("v"), "k", "id")
    text = ordered.with_position(df.withColumn("t", F.col("id").cast("string")), ["k"], "t", min_rows=20)
    assert text.agg(F.max("point")).first()[0] == 304


def test_bins_of_a_hot_key_are_small(skewed):
    binned = ordered.with_bins(skewed, ["key"], "ts", min_rows=100)
    sizes = {(r["key"], r[ordered.BIN]): r["count"] for r in binned.groupBy("key", ordered.BIN).count().collect()}
    assert max(n for (key, _), n in sizes.items() if key == 0) < 2000 / 20
    assert {b for key, b in sizes if key != 0} == {0}


def jobs_while_building(spark, make):
    """Number of jobs that are started before anything is asked of the plan."""
    context = spark.sparkContext
    context.setJobGroup("building", "building")
    make()
    found = len(context.statusTracker().getJobIdsForGroup("building"))
    context.setJobGroup("after", "after")
    return found


def test_plans_are_built_without_jobs(spark, make_tracks, skewed):
    tracks = make_tracks({f"S{i}": [(10 + j, -50 - j, 40 + j, 1000 - j) for j in range(8)] for i in range(3)})
    grid = spark.range(4).selectExpr(
        "timestamp_ntz '2023-09-05 00:00:00' AS time", "8.0 + id AS latitude", "-52.0 + id AS longitude", "1.0 AS u10", "2.0 AS msl"
    )
    for make in [
        lambda: ordered.with_position(skewed, ["key"], "ts"),
        lambda: features.track_features(tracks),
        lambda: features.haversine_steps(tracks),
        lambda: quality.dq_verdict(tracks, grid, strict=True),
        lambda: training.training_sequences(tracks, 3, 2),
        lambda: training.aligned_windows_patches(tracks, grid, 6, 2, 1),
        lambda: ensembles.ensemble_median(skewed, ["key"], ["v"]),
        lambda: ensembles.crps_ensemble(skewed, skewed.select("key", F.col("v").alias("y")), ["key"], "v", "y"),
        lambda: asof.nearest_analysis(tracks, grid),
        lambda: patches.patch_images(grid, tracks, step_hours=6),
    ]:
        assert jobs_while_building(spark, make) == 0


@pytest.mark.parametrize("size", [4, 10, 1000, 10**6])
def test_blocks_give_exact_neighbours(skewed, size):
    numbered = skewed.withColumn("point", F.row_number().over(plain_window()))
    over = ordered.run_window(["key"])
    blocked = ordered.blocks(numbered, before=3, after=2, size=size)
    found = ordered.settle(
        blocked.withColumn("back", F.lag("v", 3).over(over))
        .withColumn("next", F.lead("v", 2).over(over))
        .withColumn("run", F.sum("v").over(over.rowsBetween(-3, 2)))
    )
    plain = (
        numbered.withColumn("back", F.lag("v", 3).over(plain_window()))
        .withColumn("next", F.lead("v", 2).over(plain_window()))
        .withColumn("run", F.sum("v").over(plain_window().rowsBetween(-3, 2)))
    )
    names = ["id", "point", "back", "next", "run"]
    assert rows(found.select(names), "id") == rows(plain.select(names), "id")


def test_block_must_cover_reach(skewed):
    with pytest.raises(ValueError):
        ordered.blocks(skewed.withColumn("point", F.lit(1)), before=4, size=4)


def test_operators_do_not_depend_on_block_size(make_tracks):
    tracks = make_tracks(
        {f"S{i}": [(10 + j * (i + 1) * 0.3, -50 - j * 0.7, 30 + (j * 17 + i) % 60, 990 - j) for j in range(23)] for i in range(3)}
    )
    whole = features.track_features(tracks)
    small = features.track_features(tracks, block_rows=5)
    assert rows(whole, "storm_id", "timestamp") == rows(small, "storm_id", "timestamp")
    whole = features.sliding_sequences(tracks, 4, 2, features.STATE_FEATURES)
    small = features.sliding_sequences(tracks, 4, 2, features.STATE_FEATURES, block_rows=6)
    assert rows(whole, "storm_id", "window_index") == rows(small, "storm_id", "window_index")
    rules = quality.TRACK_RULES + quality.PHYSICS_RULES + ["position_jump"]
    whole, small = (quality.track_checks(tracks, rules, block_rows=n) for n in (10**6, 3))
    assert rows(whole, "storm_id") == rows(small, "storm_id")


def test_filtered_tables_are_numbered_anew(make_tracks):
    """A column named point is data, not a row number, once rows were filtered out."""
    tracks = make_tracks({"S0": [(10 + i * 0.5, -50 - i, 40 + i, 1000 - i) for i in range(12)]})
    numbered = ordered.with_position(tracks, ["storm_id"], "timestamp").filter("point > 3 AND point != 7")
    plain = numbered.drop("point")
    for make, by in [
        (lambda t: features.track_features(t), ("storm_id", "timestamp")),
        (lambda t: features.sliding_sequences(t, 2, 2), ("storm_id", "window_index")),
        (lambda t: features.aligned_windows(t, 2, 1), ("storm_id", "window_index")),
        (lambda t: history_truth_split(t, 2, 2), ("storm_id", "timestamp")),
    ]:
        assert rows(make(numbered).drop("point"), *by) == rows(make(plain), *by)
    assert history_truth_split(numbered, 2, 2).count() == 4
