"""Row-wise operators take a streaming table unchanged."""

from datetime import datetime

from tempestry.functions.clock import temporal_features
from tempestry.operators import grid as gr
from tempestry.operators import tracks as tr
from tempestry.sources import best_track


def drain(spark, df, name, tmp_path):
    query = (
        df.writeStream.format("memory").queryName(name)
        .option("checkpointLocation", str(tmp_path / f"{name}_progress"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.table(name)


def test_row_wise_operators_on_a_stream(spark, make_tracks, tmp_path):
    tracks = make_tracks({"A": [(10, 20, 70, 990), (11, 21, 30, 1000)]})
    tracks.write.parquet(str(tmp_path / "tracks"))
    stream = spark.readStream.schema(tracks.schema).parquet(str(tmp_path / "tracks"))
    made = drain(spark, temporal_features(tr.add_category(stream)), "seen_tracks", tmp_path)
    assert sorted(r.category for r in made.collect()) == [0, 1]

    cube = spark.createDataFrame(
        [(datetime(2023, 1, 1), 1.0, 2.0, 3.0, 4.0)],
        "time timestamp_ntz, latitude double, longitude double, u10 double, v10 double",
    )
    cube.write.parquet(str(tmp_path / "cube"))
    stream = spark.readStream.schema(cube.schema).parquet(str(tmp_path / "cube"))
    made = drain(spark, gr.grid_shear(gr.grid_thermo(gr.grid_wind(stream))), "seen_cube", tmp_path)
    assert made.first()["wind_speed"] == 5.0


def test_fix_lines_on_a_stream(spark, tmp_path):
    lines = spark.createDataFrame(
        [("QX052030, WILLOW, 3,", "20300812, 0000,  , TD, 13.7N,  28.4W,  25, 1010")], "_storm string, value string"
    )
    lines.write.parquet(str(tmp_path / "lines"))
    stream = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "lines"))
    made = drain(spark, best_track.decode_fixes(stream), "seen_fixes", tmp_path)
    assert made.first()["longitude"] == -28.4
