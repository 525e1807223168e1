"""Baselines, scores, ensembles, forecasts and model hooks on known values."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tempestry.operators import baselines as bl
from tempestry.operators import ensembles as en
from tempestry.operators import hooks, ordered
from tempestry.operators import metrics as mt
from tempestry.plans import evaluate as ev
from tempestry.plans import forecast as fc
from tempestry.sources import sinks


def ramp(n, wind=40.0, step=1.0):
    return [(i * step, i * step, wind + 2 * i) for i in range(n)]


def test_baselines(make_tracks):
    made = bl.baseline_forecasts(make_tracks({"A": ramp(6)}), 3)
    got = {}
    for r in made.orderBy("step").collect():
        got.setdefault(r.forecast, []).append((round(r.latitude, 9), round(r.longitude, 9), r.max_wind))
    assert got["persistence"] == [(5, 5, 50)] * 3
    assert got["cliper5"] == [(6, 6, 50), (7, 7, 50), (8, 8, 50)]
    assert got["gfs"] == [(6.1, 6.1, 50), (7.2, 7.2, 50), (8.3, 8.3, 50)]
    assert got["ecmwf"] == [(5.9, 5.9, 50), (6.8, 6.8, 50), (7.7, 7.7, 50)]


def test_baselines_use_five_moves_and_fall_back(make_tracks):
    turning = [(0, 0, 10), (50, 50, 10)] + [(50 + i, 50.0, 10) for i in range(1, 6)]
    tracks = make_tracks({"A": turning, "B": [(10, 20, 60)]})
    got = rows(bl.baseline_forecasts(tracks, 2, ["gfs", "unknown"]).drop("forecast"), "storm_id", "step")
    assert got[0][2] == pytest.approx(55 + 1.1) and got[0][3] == 50
    assert got[2][2:] == got[3][2:] == (10, 20, 60)
    with pytest.raises(ValueError):
        bl.baseline_forecasts(tracks, 2, ["unknown"])


def test_registered_baseline(make_tracks):
    def north(history, steps):
        last = bl.recent_motion(history, "step" if "step" in history.columns else "timestamp")
        return bl.extrapolate(last, steps, ["persistence"]).withColumn("latitude", F.col("latitude") + F.col("step"))

    bl.register_baseline("north", north)
    try:
        tracks = make_tracks({"A": ramp(6)})
        done = ev.evaluate(tracks, 4, 2, baselines=["persistence", "north"], metrics=["intensity_mae"])
        assert {r.forecast for r in done.summary.collect()} == {"persistence", "north"}
    finally:
        bl._BUILDERS.clear()


def scores_of(spark, forecast, truth, metrics=None, history=((-1.0, -1.0, 0.0),)):
    """Scores of one forecast given as [(lat, lon, wind)], through the pairing of given forecasts."""
    fixes = [*history, *truth]
    start = datetime(2023, 1, 1)
    tracks = spark.createDataFrame(
        [("A", start + timedelta(hours=6 * i), *map(float, f)) for i, f in enumerate(fixes)],
        "storm_id string, timestamp timestamp_ntz, latitude double, longitude double, max_wind double",
    )
    made = spark.createDataFrame(
        [("A", "x", i + 1, *(None if v is None else float(v) for v in f)) for i, f in enumerate(forecast)],
        "storm_id string, forecast string, step int, latitude double, longitude double, max_wind double",
    )
    cases, _short = mt.storm_cases(tracks, len(history), len(truth))
    return mt.score(mt.forecast_pairs(made, cases, len(truth)), metrics).first()


def test_along_and_cross_errors(spark):
    got = scores_of(spark, [(0, 0, 10), (1, 1.5, 10)], [(0, 0, 10), (0, 1, 10)])
    assert got["along_track_error"] == pytest.approx(55.5, rel=0.02)
    assert got["cross_track_error"] == pytest.approx(111.0, rel=0.02)


def test_intensity_scores(spark):
    truth = [(0, i, w) for i, w in enumerate([40, 45, 50, 55, 70, 75])]
    forecast = [(0, i, w) for i, w in enumerate([40, 45, 50, 55, 65, 90])]
    got = scores_of(spark, forecast, truth)
    assert got["intensity_mae"] == pytest.approx(20 / 6)
    assert got["rapid_intensification_skill"] == pytest.approx(2 / 3)
    assert got["track_error"] == 0 and got["track_rmse"] == 0


def test_no_events_and_short_forecasts(spark):
    flat = [(0, i, 40) for i in range(4)]
    assert scores_of(spark, flat, flat)["rapid_intensification_skill"] == 0.0
    still = [(0, 0, 40)] * 3
    got = scores_of(spark, still, still)
    assert got["along_track_error"] is None and got["track_error"] == 0


def test_missing_prediction_makes_scores_missing(spark):
    truth = [(0, i, 40) for i in range(3)]
    got = scores_of(spark, [(0, 0, 40), (None, None, None), (0, 2, 40)], truth)
    assert got["track_error"] is None and got["intensity_mae"] is None and got["along_track_error"] is None
    only = scores_of(spark, truth, truth, metrics=["track_error", "nonsense"])
    assert set(only.asDict()) == {"storm_id", "forecast", "track_error"}


def test_evaluate_matches_published_example(make_tracks):
    """Two straight storms, history 3, forecast 2: known mean scores of every method."""
    storms = {}
    for name, moves in (("AL012022", 0.15), ("AL022022", None)):
        storms[name] = ramp(5, 50)
    done = ev.evaluate(make_tracks(storms), 3, 2)
    got = {r.forecast: r for r in done.summary.collect()}
    assert got["cliper5"]["track_error"] == pytest.approx(0, abs=1e-6)
    assert got["persistence"]["intensity_mae"] == 3.0
    assert got["gfs"]["track_error"] == pytest.approx(got["ecmwf"]["track_error"], rel=1e-2)
    assert got["persistence"]["cross_track_error"] < 1


def test_both_pairings_agree(make_tracks):
    """Baselines scored from cases equal the same forecasts scored as given ones."""
    tracks = make_tracks({f"S{k}": [(i + k * 0.1 * i * i, -i * 1.3, 30 + (i * (7 + k)) % 50) for i in range(15 + k)] for k in range(3)})
    done = ev.evaluate(tracks, 8, 6)
    given_ones = bl.baseline_forecasts(ev.history_of(tracks, 8, 6), 6, order="step")
    cases, _short = mt.storm_cases(tracks, 8, 6)
    other = mt.score(mt.forecast_pairs(given_ones, cases, 6))
    for a, b in zip(rows(done.per_storm, "storm_id", "forecast"), rows(other, "storm_id", "forecast")):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-9)


def test_short_storms_are_reported(make_tracks):
    done = ev.evaluate(make_tracks({"A": ramp(6), "B": ramp(3)}), 4, 2)
    assert [tuple(r) for r in done.short_storms.collect()] == [("B", 3)]
    assert done.per_storm.select("storm_id").distinct().count() == 1


def test_point_column_is_only_filtered(make_tracks):
    tracks = make_tracks({"A": ramp(9), "B": ramp(7, 30)})
    numbered = ordered.with_position(tracks, ["storm_id"], "timestamp")
    a = rows(ev.evaluate(tracks, 4, 2).per_storm, "storm_id", "forecast")
    assert a == rows(ev.evaluate(numbered, 4, 2).per_storm, "storm_id", "forecast")


def test_failed_model_is_noticed(make_tracks):
    tracks = make_tracks({"A": ramp(6), "B": ramp(6, 90)})

    def picky(features, steps, step_hours):
        if features["max_wind"].max() > 90:
            raise RuntimeError("too strong")
        return features.tail(1).loc[lambda f: f.index.repeat(steps)]

    history = ev.history_of(tracks, 4, 2)
    made = hooks.storm_forecaster(history, picky, 2, name="picky", order="step")
    done = ev.evaluate(tracks, 4, 2, models=made, model_names=["picky"])
    got = {(r.storm_id, r.forecast): r.track_error for r in done.per_storm.collect()}
    assert got["B", "picky"] is None and got["A", "picky"] == pytest.approx(got["A", "persistence"])
    assert {r.forecast: r.track_error for r in done.summary.collect()}["picky"] is None
    with pytest.raises(ValueError):
        sinks.require_complete(done.per_storm)


def test_custom_metrics(make_tracks):
    tracks = make_tracks({"A": ramp(6)})
    mt.register_metric("worst_km", lambda: F.max("km"))
    try:
        done = ev.evaluate(tracks, 4, 2, metrics=["worst_km", "track_error"]).per_storm
        assert done.filter("worst_km < track_error").count() == 0
    finally:
        del mt.METRICS["worst_km"]
    cases, _short = mt.storm_cases(tracks, 4, 2)
    pairs = mt.baseline_pairs(cases, 2, ["persistence"])
    got = mt.score_with_python(pairs, "bias", lambda rows: float((rows["wind"] - rows["true_wind"]).mean()))
    assert got.first()["bias"] == -3.0


def test_improvement(spark):
    summary = spark.createDataFrame([("a", 10.0), ("b", 8.0)], "forecast string, track_error double")
    got = {r.forecast: r.improvement_pct for r in mt.improvement_pct(summary, "a").collect()}
    assert got == {"a": 0.0, "b": pytest.approx(20.0)}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(lat=st.integers(-50, 50), lon=st.integers(-179, 179), wind=st.integers(20, 120))
def test_persistence_of_a_still_storm_is_perfect(make_tracks, lat, lon, wind):
    done = ev.evaluate(make_tracks({"A": [(lat, lon, wind)] * 6}), 4, 2, baselines=["persistence"])
    row = done.per_storm.first()
    assert row["track_error"] == 0 and row["intensity_mae"] == 0


# -- ensembles ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def members(spark):
    rng = np.random.default_rng(3)
    data = [(case, f"m{m}", float(rng.normal()), float(case)) for case in range(6) for m in range(3 + case)]
    return spark.createDataFrame(data, "case int, member string, x double, y double"), data


@pytest.mark.parametrize("limits", [{}, {"min_rows": 3}])
def test_crps_and_median_against_definitions(members, limits):
    table, data = members
    observed = table.select("case", "y").distinct()
    got = {r.case: r.crps for r in en.crps_ensemble(table, observed, ["case"], "x", "y", **limits).collect()}
    middle = {r.case: r.x for r in en.ensemble_median(table, ["case"], ["x"], **limits).collect()}
    for case in range(6):
        x = np.array([d[2] for d in data if d[0] == case])
        brute = np.abs(x - case).mean() - 0.5 * np.abs(x[:, None] - x[None, :]).mean()
        assert got[case] == pytest.approx(brute) and middle[case] == pytest.approx(np.median(x))


def test_mean_and_blend(spark):
    table = spark.createDataFrame(
        [("a", 1.0, 2.0), ("b", 3.0, None), ("c", 100.0, 100.0)], "forecast string, x double, z double"
    ).withColumn("case", F.lit(1))
    assert en.ensemble_mean(table, ["case"], ["x"]).first()["x"] == pytest.approx(104 / 3)
    blend = en.ensemble_blend(table, {"a": 0.5, "b": 1.5}, ["case"], ["x", "z"]).first()
    assert blend["x"] == pytest.approx(2.5) and blend["z"] == 2.0


def test_reliability_bins(spark):
    data = [(0.0, True), (0.1, False), (0.1000001, True), (1.0, True)]
    table = spark.createDataFrame(data, "p double, event boolean")
    got = {r.bin: (r.n_cases, r.event_frequency) for r in en.reliability_curve(table, "p", "event").collect()}
    assert got == {1: (2, 0.5), 2: (1, 1.0), 10: (1, 1.0)}


# -- forecast tracks ---------------------------------------------------------------------------


def test_forecast_track(make_tracks):
    tracks = make_tracks({"A": [(10 + i, -50 - i, 40 + i, 1000) for i in range(4)]})
    track, verdict = fc.checked_forecast(tracks, forecast_hours=12)
    got = track.orderBy("lead_time").collect()
    assert [r.lead_time for r in got] == [0, 6, 12, 18, 24, 30]
    assert [r.is_forecast for r in got] == [False] * 4 + [True] * 2
    assert (got[5].latitude, got[5].max_wind, got[5].min_pressure, got[5].name) == (13, 43, 1000, "A")
    assert got[5].timestamp == got[3].timestamp + timedelta(hours=12)
    assert verdict.first()["track_valid"]
    assert fc.storm_position_at_lead(track, "A", 30) == (13.0, -53.0)
    with pytest.raises(ValueError):
        fc.storm_position_at_lead(track, "A", 31)
    assert fc.track_cone(track).count() == 6


def test_smoothing_touches_forecast_only(make_tracks):
    tracks = make_tracks({"A": [(i, 0, 40, 1000) for i in range(4)]})
    track = fc.forecast_track(tracks, 24, 6, method="cliper5")
    got = [r.latitude for r in track.orderBy("lead_time").collect()]
    assert got == pytest.approx([0, 1, 2, 3, 4, 4.5, 5, 6])
    rough = fc.forecast_track(tracks, 24, 6, method="cliper5", smooth=False)
    assert [r.latitude for r in rough.orderBy("lead_time").collect()] == pytest.approx(range(8))


# -- models ------------------------------------------------------------------------------------


def test_model_rollout(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "id int, state array<float>")
    once = hooks.model_score(table, "state", lambda a: a + 1)
    assert rows(once.select("id", "prediction"), "id") == [(1, [2.0, 3.0]), (2, [4.0, 5.0])]
    last = hooks.model_rollout(table, "state", lambda a: a + 1, 3)
    assert rows(last.select("id", "prediction"), "id") == [(1, [4.0, 5.0]), (2, [6.0, 7.0])]
    every = hooks.model_rollout(table, "state", lambda a: a + 1, 3, every_step=True)
    assert every.count() == 6 and every.filter("id = 2 and step = 2").first()["prediction"] == [5.0, 6.0]


# -- missing values, errors and columns of any name ----------------------------------------------


def test_nan_members_are_missing(spark):
    nan = float("nan")
    table = spark.createDataFrame([(1, 1.0, 2.0), (1, nan, 2.0), (1, 3.0, 2.0), (2, nan, 1.0), (3, 5.0, nan)], "case int, x double, y double")
    truth = table.select("case", "y").distinct()
    got = {r.case: (r.n_members, r.crps) for r in en.crps_ensemble(table, truth, ["case"], "x", "y").collect()}
    assert got == {1: (2, pytest.approx(1.0 - 0.5)), 3: (1, None)}
    assert {r.case: r.x for r in en.ensemble_median(table, ["case"], ["x"]).collect()} == {1: 2.0, 3: 5.0}


def test_a_hot_case_stays_split(spark):
    """A third of all members belong to one case: they are exchanged by value bins, and the scores are exact."""
    rng = np.random.default_rng(5)
    data = [(0 if i % 3 == 0 else i % 50 + 1, float(v)) for i, v in enumerate(rng.exponential(size=6000))]
    table = spark.createDataFrame(data, "case int, x double")
    truth = spark.createDataFrame([(c, 0.5) for c in range(51)], "case int, y double")
    binned = ordered.spread(ordered.with_bins(table, ["case"], "x", 200), ["case"])
    sizes = binned.groupBy(ordered.HOME).count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 200 and sizes[1] > 100
    got = {r.case: r.crps for r in en.crps_ensemble(table, truth, ["case"], "x", "y", min_rows=200).collect()}
    middle = {r.case: r.x for r in en.ensemble_median(table, ["case"], ["x"], min_rows=200).collect()}
    for case in range(51):
        x = np.sort([v for c, v in data if c == case])
        n = len(x)
        spread = ((2 * np.arange(1, n + 1) - n - 1) * x).sum() / n**2
        assert got[case] == pytest.approx(np.abs(x - 0.5).mean() - spread) and middle[case] == pytest.approx(np.median(x))


def test_nan_truth_gives_missing_scores(make_tracks):
    tracks = make_tracks({"A": [(10, 20, 30), (11, 21, 31), (float("nan"), 22, 32), (13, 23, 33), (14, 24, 34)]})
    row = ev.evaluate(tracks, 2, 3, baselines=["persistence"]).per_storm.first().asDict()
    assert row["track_error"] is None and row["along_track_error"] is None and row["cross_track_error"] is None
    assert row["intensity_mae"] is not None


def test_partial_states_of_a_metric_are_merged(spark):
    data = [(f"S{i % 2}" if i % 7 else None, "f", i, float(i % 13)) for i in range(500)]
    pairs = spark.createDataFrame(data, "storm_id string, forecast string, step int, wind double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        made = mt.score_with_partials(
            pairs, "top", lambda rows: [len(rows), rows["wind"].sum()], lambda a, b: [a[0] + b[0], a[1] + b[1]],
            lambda s: s[1] / s[0], held=1,
        ).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for storm, _, _, wind in data:
        want.setdefault(storm, []).append(wind)
    assert {r.storm_id: pytest.approx(r.top) for r in made} == {k: sum(v) / len(v) for k, v in want.items()}


def test_model_errors_are_shown(make_tracks):
    def predict(features, steps, step_hours):
        if features["max_wind"].max() > 50:
            raise ValueError("too strong")
        return features.tail(1).loc[lambda f: f.index.repeat(steps)]

    tracks = make_tracks({"A": [(10, 20, 30)] * 3, "B": [(10, 20, 60)] * 3})
    made = hooks.storm_forecaster(tracks, predict, 2).collect()
    assert {(r.storm_id, r.error) for r in made} == {("A", None), ("B", "ValueError: too strong")}
    assert len(made) == 4
