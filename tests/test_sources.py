"""Readers, request planning and writers."""

import random
from datetime import date, datetime
from decimal import Decimal

import __spark_entry__ as entry
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tempestry.operators import grid as gr
from tempestry.operators import metrics as mt
from tempestry.operators import tracks as tr
from tempestry.schema import TRACK_SCHEMA, with_archive_radius_names
from tempestry.sources import arrays, best_track, requests, sinks, tiles

#: Made-up storms: a note before any header, missing values, both hemispheres, short and long clock times.
TEXT = """\
note of the editor, 7
QX032031,        OLIVE,     4,
20310310, 0000,  , TD, 11.5N,  31.0W,  25, 1011,    0,    0,    0,    0,    0,    0,    0,    0,    0,    0,    0,    0,
20310310, 0600,  , TD, 11.9N,  32.2W,  25, -999, -999,   15,     ,    0,    0,    0,    0,    0,    0,    0,    0,    0,
20310310, 1200,  , TD, 12.4S,  33.1E, -99, 1009,    0,    0,    0,    0,    0,    0,    0,    0,    0,    0,    0,    0,
20310310, 1800, P, TS, 12.8N,  34.6W,    , 1003,   40,   35,   25,   25,    0,    0,    0,    0,    0,    0,    0,    0,
QX111998,     MAPLE,     2,
19980702, 15,  , TD, 19.2N,  58.3W,  35, 1006
19980703, 0045,  , TD, 19.6N,  58.9W,  35, 1005
"""


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    path = tmp_path_factory.mktemp("archive") / "tracks.txt"
    path.write_text(TEXT)
    return str(path)


def test_best_track_text(spark, archive):
    tracks = best_track.read_best_track(spark, archive)
    assert tracks.schema == TRACK_SCHEMA
    got = rows(tracks, "storm_id", "timestamp")
    assert len(got) == 6
    first, second, third, fourth, fifth, sixth = got
    assert first == (
        "QX032031", "OLIVE", datetime(2031, 3, 10), "", "TD", 11.5, -31.0, 25.0, 1011.0, 0.0, 0.0, 0.0, 0.0
    )
    assert second[8:] == (None, None, 15.0, None, 0.0)
    assert third[5:8] == (-12.4, 33.1, -99.0)
    assert fourth[3] == "P" and fourth[7] is None
    assert fifth[2] == datetime(1998, 7, 2, 15) and fifth[9:] == (None,) * 4
    assert sixth[2] == datetime(1998, 7, 3, 0, 45)


def test_wind_sentinel_option(spark, archive):
    tracks = best_track.read_best_track(spark, archive, null_wind_sentinel=True)
    assert tracks.filter(F.col("max_wind") < 0).count() == 0


def test_header_of_an_earlier_split(spark, archive):
    """Small read splits cut storms in the middle; every fix keeps its storm."""
    big = TEXT.splitlines()[1:]
    whole = rows(best_track.read_best_track(spark, archive), "storm_id", "timestamp")
    default = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    try:
        lines = best_track.read_lines(spark, archive)
        assert lines.select("block").distinct().count() > 3
        assert rows(best_track.parse_lines(lines), "storm_id", "timestamp") == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", default)
    assert len(big) == 8


def test_bad_fields_become_null(spark):
    lines = spark.createDataFrame(
        [("f", 0, 0, "AL012020, X, 1,"), ("f", 0, 1, "20201399, 0000, , TS, N, 12, abc, , 1")],
        "file string, block long, line_no long, value string",
    )
    row = best_track.parse_lines(lines).first()
    assert row["timestamp"] is None and row["latitude"] is None and row["max_wind"] is None


def test_radius_names(spark, archive):
    named = with_archive_radius_names(best_track.read_best_track(spark, archive))
    assert {"34kt_ne", "34kt_nw"} <= set(named.columns)


def test_storm_arrays(spark):
    nan = float("nan")
    archive = spark.createDataFrame(
        [
            (bytearray(b"TESTSID  "), bytearray(b"TEST "), [datetime(2023, 1, 1), datetime(2023, 1, 2), None, datetime(2023, 1, 3)],
             [10.0, 11.0, 12.0, nan], [20.0, 21.0, 22.0, 23.0], [30, 40, 50, 60], [1000, 995, 990, 985]),
        ],
        "sid binary, name binary, time array<timestamp_ntz>, lat array<double>, lon array<double>,"
        " wmo_wind array<int>, wmo_pres array<int>",
    )
    got = rows(arrays.explode_storm_arrays(archive), "timestamp")
    assert got == [
        ("TESTSID", "TEST", datetime(2023, 1, 1), 10.0, 20.0, 30.0, 1000.0),
        ("TESTSID", "TEST", datetime(2023, 1, 2), 11.0, 21.0, 40.0, 995.0),
    ]
    assert arrays.storm_from_arrays(archive, "TESTSID").count() == 2
    with pytest.raises(Exception, match="storm OTHER is not in the archive"):
        arrays.storm_from_arrays(archive, "OTHER").collect()


REQUEST = (
    "storm_id string, start_time timestamp_ntz, end_time timestamp_ntz, north double, west double,"
    " south double, east double, variables array<string>"
)


def make_request(spark, *periods, variables=None):
    data = [(f"S{i}", a, b, 10.0, -20.0, 5.0, -15.5, variables) for i, (a, b) in enumerate(periods)]
    return spark.createDataFrame(data, REQUEST)


def test_year_split(spark):
    asked = make_request(
        spark,
        (datetime(2022, 12, 30), datetime(2023, 1, 2)),
        (datetime(2022, 12, 31, 6), datetime(2022, 12, 31, 18)),
        (datetime(2021, 12, 31, 12), datetime(2023, 1, 1)),
    )
    got = rows(
        requests.year_split_periods(asked).select("storm_id", "year", "period_start", "period_end"),
        "storm_id", "year",
    )
    assert got == [
        ("S0", 2022, datetime(2022, 12, 30), datetime(2022, 12, 31, 23, 59, 59, 999999)),
        ("S0", 2023, datetime(2023, 1, 1), datetime(2023, 1, 2)),
        ("S1", 2022, datetime(2022, 12, 31, 6), datetime(2022, 12, 31, 18)),
        ("S2", 2021, datetime(2021, 12, 31, 12), datetime(2021, 12, 31, 23, 59, 59, 999999)),
        ("S2", 2022, datetime(2022, 1, 1), datetime(2022, 12, 31, 23, 59, 59, 999999)),
        ("S2", 2023, datetime(2023, 1, 1), datetime(2023, 1, 1)),
    ]


def test_days_and_hours(spark):
    asked = make_request(
        spark,
        (datetime(2023, 1, 1, 18), datetime(2023, 1, 3, 6)),
        (datetime(2021, 12, 31, 12), datetime(2022, 1, 1)),
    )
    days = requests.period_day_expand(requests.year_split_periods(asked))
    got = {(r.storm_id, str(r.date)) for r in days.select("storm_id", "date").collect()}
    assert got == {("S0", "2023-01-01"), ("S0", "2023-01-02"), ("S0", "2023-01-03"), ("S1", "2021-12-31"), ("S1", "2022-01-01")}
    assert days.filter("storm_id = 'S1'").count() == 48
    # the old rules: 24 h steps from 18:00 miss the last date, and a year ends as December 31 begins
    stepped = requests.period_day_expand(requests.year_split_periods(asked, last_midnight=True), step_from_start=True)
    got = {(r.storm_id, str(r.date)) for r in stepped.select("storm_id", "date").collect()}
    assert got == {("S0", "2023-01-01"), ("S0", "2023-01-02"), ("S1", "2022-01-01")}


def test_routing_and_keys(spark):
    period = (datetime(2023, 1, 1), datetime(2023, 1, 2))
    asked = make_request(spark, period, variables=["z", "2m_temperature", "a"])
    routed = requests.variable_routing(asked).first()
    assert routed["single_level"] == ["2m_temperature"]
    assert routed["pressure_level"] == ["z", "a"] and routed["levels"] == ["200", "850"]
    default = requests.variable_routing(make_request(spark, period)).first()
    assert default["single_level"] == requests.SINGLE_LEVEL
    only_single = requests.variable_routing(make_request(spark, period, variables=["2m_temperature"]))
    assert only_single.first()["levels"] == []

    def key(variables):
        return requests.extract_key(make_request(spark, period, variables=variables), "era").first()["extract_key"]

    assert key(["u10", "v10"]) == key(["v10", "u10"]) != key(["u10"])
    assert key(None) == key([]) == "era_20230101_20230102_10.0N_20.0W_5.0N_15.5W_default"


def test_pending(spark):
    asked = requests.extract_key(
        make_request(spark, (datetime(2023, 1, 1), datetime(2023, 1, 2)), (datetime(2023, 2, 1), datetime(2023, 2, 2))), "sat"
    )
    done = asked.filter("storm_id = 'S0'")
    assert [r.storm_id for r in requests.pending_extracts(asked, done).collect()] == ["S1"]


def test_tiles(make_tracks):
    made = tiles.tile_placeholders(make_tracks({"A": [(10, 20), (12, 24)]}), 4.0)
    assert made.count() == 8
    corners = {(r.latitude, r.longitude) for r in made.collect()}
    assert corners == {(8.0, 18.0), (8.0, 26.0), (14.0, 18.0), (14.0, 26.0)}
    assert dict(made.dtypes)["ir1"] == "float" and made.agg(F.sum("ir2")).first()[0] == 0


def test_stats_round_trip(spark, tmp_path):
    fields = spark.createDataFrame([(1.0, 2.0), (3.0, 8.0)], "u10 double, v10 double")
    stats = gr.grid_stats_fit(fields)
    sinks.save_stats(stats, str(tmp_path / "stats"))
    assert rows(sinks.load_stats(spark, str(tmp_path / "stats")), "variable") == rows(stats, "variable")


def test_score_files_and_guard(spark, tmp_path):
    scores = spark.createDataFrame([("A", "gfs", 1.5)], "storm_id string, forecast string, track_error double")
    sinks.write_scores(scores, str(tmp_path / "s.json"))
    sinks.write_scores(scores, str(tmp_path / "s.csv"))
    assert spark.read.json(str(tmp_path / "s.json")).first()["track_error"] == 1.5
    assert spark.read.option("header", True).csv(str(tmp_path / "s.csv")).first()["forecast"] == "gfs"
    sinks.require_complete(scores)
    broken = scores.unionByName(scores.withColumn("track_error", F.lit(None).cast("double")))
    with pytest.raises(ValueError, match="track_error"):
        sinks.require_complete(broken)
    assert mt.score_summary(broken, strict=True).first()["track_error"] is None
    assert mt.score_summary(broken).first()["track_error"] == 1.5


def test_storm_dataset_and_grid_files(spark, make_tracks, tmp_path):
    tracks = make_tracks({"A": [(10, 20)], "B": [(11, 21), (12, 22)]})
    sinks.write_storm_dataset(tracks, str(tmp_path / "d"), csv=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "d" / "track")).count() == 3
    boxes = tracks.select("storm_id", "latitude")
    for per_storm in (False, True):
        out = tmp_path / f"p{per_storm}"
        sinks.write_storm_dataset(tracks, str(out), grid=boxes, per_storm=per_storm)
        assert spark.read.parquet(str(out / "grid")).filter("storm_id = 'B'").count() == 2
        assert (out / "track" / "storm_id=A").is_dir() == per_storm
    cube = spark.createDataFrame(
        [(datetime(2022, 12, 31), 1.0), (datetime(2023, 1, 1), 2.0)], "time timestamp_ntz, u10 double"
    )
    sinks.write_grid(cube, str(tmp_path / "g"))
    assert [r.u10 for r in sinks.read_grid(spark, str(tmp_path / "g"), [2023]).collect()] == [2.0]
    assert sinks.read_grid(spark, str(tmp_path / "g")).columns == ["time", "u10"]


ODD_IDS = [
    "0042", "42", "a b", "a/b", "50%", "%41", "a+b", "a=b", "ü é", "x:y", "q?#", "[z]", "{w}", "^", "'", '"', "\\", "\t", "*", ".h", "_u", "1e3", "2020-01-01",
    "__HIVE", "", None,
]


@pytest.mark.parametrize("local", [True, False])
def test_one_directory_per_storm_keeps_rows(spark, tmp_path, monkeypatch, local):
    """Whatever writes the files: ids, missing values, old dates, repeated rows and storms over several batches come back."""
    if not local:
        monkeypatch.setattr(sinks, "local_folder", lambda spark, path: None)
    monkeypatch.setattr(sinks, "GROUP_ROWS", 5)
    made = [
        (n, i, datetime(1500 + 20 * k, 1, 2, 3), datetime(1800 + n, 5, 6), date(1400 + n, 7, 8), Decimal(n) / 8, bool(k % 2), bytes([n]), None if k == 1 else float(k))
        for n, i in enumerate(ODD_IDS)
        for k in range(24 if i == "42" else 3)
    ]
    kinds = "n int, storm_id string, timestamp timestamp_ntz, seen timestamp, day date, part decimal(9, 3), odd boolean, raw binary, latitude double"
    tracks = spark.createDataFrame(made + made[:2], kinds)
    path = str(tmp_path / "a b%20c+d")
    sinks.write_storm_dataset(tracks.select("storm_id", F.lit("gone").alias("was")), path, per_storm=True)
    with_conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {k: spark.conf.get(k) for k in with_conf}
    try:
        for k, v in with_conf.items():
            spark.conf.set(k, v)
        sinks.write_storm_dataset(tracks, path, per_storm=True)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    back = sinks.read_by_storm(spark, f"{path}/track", tracks.schema)
    want = tracks.withColumn("storm_id", F.nullif("storm_id", F.lit("")))
    order = ["n", "timestamp"]
    assert rows(back.select(*tracks.columns), *order) == rows(want, *order)
    assert dict(back.dtypes) == dict(tracks.dtypes)
    found = spark.read.parquet(f"{path}/track")
    assert rows(found.select(*tracks.columns), *order) == rows(want, *order)
    assert dict(found.dtypes) == dict(tracks.dtypes)
    at = tmp_path / "a b%20c+d" / "track"
    assert (at / "_SUCCESS").exists() and (at / "storm_id=a%2Fb").is_dir()
    assert bool(list(at.glob("storm_id=*/.*.crc"))) != local


def test_no_rows_per_storm(spark, make_tracks, tmp_path):
    tracks = make_tracks({"A": [(10, 20)]}).where("latitude > 50")
    sinks.write_storm_dataset(tracks, str(tmp_path / "d"), per_storm=True)
    assert sinks.read_by_storm(spark, str(tmp_path / "d" / "track"), tracks.schema).count() == 0


def test_storms_are_no_partitions_of_the_written_dataset(spark, tmp_path):
    """Spark's discovery of partitions takes time that grows with the square of the number of storms."""
    events = [(n, datetime(2024, 1, 1 + n % 9), n % 4, "view", float(n), "{}") for n in range(24)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(
        str(tmp_path / "events.parquet")
    )
    vectors = [(n, [0.25] * 64, 1) for n in range(10)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = entry.queries()["storm_dataset_written"](spark, str(tmp_path))
    leaves = found._jdf.queryExecution().optimizedPlan().collectLeaves()
    places = [leaves.apply(n).relation().location() for n in range(leaves.size())]
    assert len(places) == 3 and all(place.partitionSpec().partitions().isEmpty() for place in places)
    parts = {part: rows(found.where(F.col("part") == part).drop("part"), "storm_id", "time", "value") for part in ("track", "track by storm")}
    assert len(parts["track"]) == 24 and parts["track"] == parts["track by storm"]
    assert found.where("part = 'grid'").count() == 64


# -- one pass over splits ------------------------------------------------------------------------


def archive_lines(rng, storms):
    """Lines of one file, and per fix (storm, name, line number)."""
    lines, want, storm = ["loose words"], [], None
    for i in range(storms):
        storm = (f"ZZ{i % 90 + 10:02d}2019", f"NAME{i}")
        lines.append(f"{storm[0]},  {storm[1]},  0,")
        for _ in range(rng.randint(0, 9)):
            if rng.random() < 0.1:
                lines.append("   ")
            want.append((*storm, len(lines)))
            lines.append(f"20190{rng.randint(1, 9)}15, 0600,  , TS, 11.0N,  60.0W,  {rng.randint(20, 90)}, 1001")
    return lines, want


@pytest.mark.parametrize("split_bytes,arrow_rows", [(10**6, 10_000), (200, 10_000), (90, 2)])
def test_scan_keeps_storms_and_line_numbers(spark, tmp_path, split_bytes, arrow_rows):
    """However files are cut into splits and splits into batches, every fix keeps its storm and its line."""
    rng = random.Random(split_bytes)
    expected = []
    for n in range(3):
        lines, want = archive_lines(rng, 12)
        (tmp_path / f"part{n}.txt").write_text("\n".join(lines) + "\n")
        expected += [(f"part{n}.txt", *w) for w in want]
    settings = {"spark.sql.files.maxPartitionBytes": str(split_bytes), "spark.sql.execution.arrow.maxRecordsPerBatch": str(arrow_rows)}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        tracks = best_track.read_best_track(spark, str(tmp_path / "part*.txt"), line_numbers=True, folder=str(tmp_path / "staged"))
        got = [(r.file.rsplit("/", 1)[1], r.storm_id, r.name, r.line_no) for r in tracks.collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(got) == sorted(expected)
    first = {}
    for file, storm, name, number in sorted(expected):
        first.setdefault(storm, name)
    catalog = tr.storm_catalog(tracks, ["file", "line_no"]).collect()
    assert {r.storm_id: r.name for r in catalog} == first


def test_scan_of_nothing(spark, tmp_path):
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "no_storm.txt").write_text("20190115, 0600,  , TS, 11.0N,  60.0W,  30, 1001\n")
    for name in ("empty", "no_storm"):
        tracks = best_track.read_best_track(spark, str(tmp_path / f"{name}.txt"), folder=str(tmp_path / "staged"))
        assert tracks.count() == 0 and tracks.schema == TRACK_SCHEMA


def test_scan_exchanges_no_lines(spark, archive):
    """What is read after the pass has an exchange for the few orphans at most, none for fixes."""
    tracks = best_track.read_best_track(spark, archive)
    fixes, orphans = tracks._jdf.queryExecution().optimizedPlan().children().mkString("~~").split("~~")
    assert "Join" not in fixes and "Window" not in fixes and "Repartition" not in fixes
    assert "Join" in orphans
