"""Queries on forecasts, scores and ensembles."""

import uuid

from pyspark.sql import functions as F

from tempestry.operators import baselines as bl
from tempestry.operators import ensembles as en
from tempestry.operators import grid as gr
from tempestry.operators import hooks
from tempestry.operators import metrics as mt
from tempestry.plans import evaluate as ev
from tempestry.sources import sinks, staging
from workload import fixtures as fx
from workload.oracle_tables import OVER, r
from workload.registry import Registry
from workload.track_queries import HAVERSINE

Q = Registry()
HISTORY, STEPS = 12, 8

_CASES = {
    "steps": f"""
        SELECT storm_id, latitude, longitude, max_wind, row_number() {OVER} AS rn,
          count(*) OVER (PARTITION BY storm_id) AS n FROM tracks""",
    "full_rows": f"SELECT * FROM steps WHERE n >= {HISTORY + STEPS} AND rn <= {HISTORY + STEPS}",
    "motion": f"""
        SELECT storm_id, a.latitude AS lat0, a.longitude AS lon0, a.max_wind AS wind0,
          (a.latitude - b.latitude) / 5 AS dlat, (a.longitude - b.longitude) / 5 AS dlon
        FROM full_rows AS a JOIN full_rows AS b USING (storm_id) WHERE a.rn = {HISTORY} AND b.rn = {HISTORY - 5}""",
    "baseline_rows": f"""
        SELECT storm_id, forecast, step, lat0 + dlat * factor * step AS lat, lon0 + dlon * factor * step AS lon, wind0 AS wind
        FROM motion, (VALUES ('persistence', 0e0), ('cliper5', 1e0), ('gfs', 1.1e0), ('ecmwf', 0.9e0)) AS m(forecast, factor),
          range(1, {STEPS + 1}) AS s(step)""",
    "truth": f"""
        SELECT storm_id, rn - {HISTORY} AS step, latitude AS true_lat, longitude AS true_lon, max_wind AS true_wind,
          lag(latitude) OVER (PARTITION BY storm_id ORDER BY rn) AS before_lat,
          lag(longitude) OVER (PARTITION BY storm_id ORDER BY rn) AS before_lon,
          lag(max_wind, 4) OVER (PARTITION BY storm_id ORDER BY rn) AS wind_base,
          avg(latitude) OVER (PARTITION BY storm_id) AS ref
        FROM full_rows WHERE rn > {HISTORY}""",
    # the analog model repeats the motion and winds of the last STEPS fixes; no forecast for strong storms
    "analog_rows": f"""
        SELECT storm_id, 'analog' AS forecast, h.rn - {HISTORY - STEPS} AS step, lat0 + h.latitude - f.latitude AS lat,
          lon0 + h.longitude - f.longitude AS lon, h.max_wind AS wind
        FROM motion JOIN full_rows AS h USING (storm_id) JOIN full_rows AS f USING (storm_id)
        WHERE f.rn = {HISTORY - STEPS} AND h.rn > {HISTORY - STEPS} AND h.rn <= {HISTORY} AND wind0 <= 100""",
}

_PLANE = {
    "pairs": """
        SELECT *, lag(wind, 4) OVER (PARTITION BY storm_id, forecast ORDER BY step) AS forecast_base
        FROM {rows} JOIN truth USING (storm_id, step)""",
    "plane": f"""
        SELECT *, {HAVERSINE.format(a="lat", b="true_lat", c="lon", d="true_lon")} AS km,
          6371e0 * radians(true_lon - before_lon) * cos(radians(ref)) AS mx, 6371e0 * radians(true_lat - before_lat) AS my,
          6371e0 * radians(lon - true_lon) * cos(radians(ref)) AS ex, 6371e0 * radians(lat - true_lat) AS ey,
          coalesce(wind - forecast_base >= 30, FALSE) AS said, coalesce(true_wind - wind_base >= 30, FALSE) AS seen
        FROM pairs""",
    "scores": """
        SELECT storm_id, forecast, avg(km) AS track_error, sqrt(avg(km * km)) AS track_rmse,
          avg(abs(ex * mx + ey * my) / sqrt(mx * mx + my * my)) FILTER (sqrt(mx * mx + my * my) > 0) AS along_track_error,
          avg(abs(mx * ey - my * ex) / sqrt(mx * mx + my * my)) FILTER (sqrt(mx * mx + my * my) > 0) AS cross_track_error,
          avg(abs(wind - true_wind)) AS intensity_mae, sqrt(avg((wind - true_wind) * (wind - true_wind))) AS intensity_rmse,
          CASE WHEN count(*) FILTER (said AND seen) = 0 THEN 0e0 ELSE 2e0 * count(*) FILTER (said AND seen)
            / (2 * count(*) FILTER (said AND seen) + count(*) FILTER (said AND NOT seen) + count(*) FILTER (seen AND NOT said)) END
            AS rapid_intensification_skill
        FROM plane GROUP BY storm_id, forecast""",
}


def _scored(rows):
    return {**_CASES, **{name: text.replace("{rows}", rows) for name, text in _PLANE.items()}}


def _history(spark, sf):
    return ev.history_of(fx.tracks(spark, sf), HISTORY, STEPS)


def _baselines(spark, sf, methods):
    return bl.baseline_forecasts(_history(spark, sf), STEPS, methods, order="step")


_FORECAST = f"storm_id, forecast, step, {r('lat AS latitude', 'lon AS longitude')}, wind AS max_wind"


def _register_baseline(name):
    @Q.add(f"baseline_{name}", f"SELECT {_FORECAST} FROM baseline_rows WHERE forecast = '{name}'", _CASES)
    def _(spark, sf):
        return _baselines(spark, sf, [name])


for _name in bl.DEFAULT_BASELINES:
    _register_baseline(_name)


@Q.add("baseline_all", f"SELECT {_FORECAST} FROM baseline_rows", _CASES)
def _(spark, sf):
    return _baselines(spark, sf, None)


# -- scores ------------------------------------------------------------------------------------


def _register_metric(key, metrics):
    @Q.add(key, f"SELECT storm_id, forecast, {r(*metrics)} FROM scores", _scored("baseline_rows"))
    def _(spark, sf):
        return ev.evaluate(fx.tracks(spark, sf), HISTORY, STEPS, metrics=metrics).per_storm


_register_metric("metric_track", ["track_error", "track_rmse"])
_register_metric("metric_along_cross", ["along_track_error", "cross_track_error"])
_register_metric("metric_intensity", ["intensity_mae", "intensity_rmse"])
_register_metric("score_per_storm", mt.DEFAULT_METRICS)


def _analog(spark, sf):
    """Forecasts that repeat each storm's recent motion and winds; none for strong storms."""
    history = _history(spark, sf)
    edges = history.groupBy("storm_id").agg(
        F.max_by(F.struct("latitude", "longitude", "max_wind"), "step").alias("last"),
        F.max(
            F.when(F.col("step") == HISTORY - STEPS, F.struct("latitude", "longitude"))
        ).alias("first"),
    )
    rows = history.filter(F.col("step") > HISTORY - STEPS).join(edges, "storm_id")
    return rows.filter(F.col("last.max_wind") <= 100).select(
        "storm_id",
        F.lit("analog").alias("forecast"),
        (F.col("step") - (HISTORY - STEPS)).alias("step"),
        (F.col("last.latitude") + F.col("latitude") - F.col("first.latitude")).alias("latitude"),
        (F.col("last.longitude") + F.col("longitude") - F.col("first.longitude")).alias("longitude"),
        "max_wind",
    )


@Q.add(
    "metric_ri_f1",
    f"SELECT storm_id, forecast, {r('rapid_intensification_skill')} FROM scores",
    _scored("analog_rows"),
)
def _(spark, sf):
    cases, _short = mt.storm_cases(fx.tracks(spark, sf), HISTORY, STEPS)
    pairs = mt.forecast_pairs(_analog(spark, sf), cases, STEPS)
    return mt.score(pairs, ["rapid_intensification_skill"])


_MEANS = [f"avg({m}) AS {m}" for m in mt.DEFAULT_METRICS]


@Q.add("score_summary", f"SELECT forecast, {r(*_MEANS)} FROM scores GROUP BY forecast", _scored("baseline_rows"))
def _(spark, sf):
    return mt.score_summary(ev.evaluate(fx.tracks(spark, sf), HISTORY, STEPS).per_storm)


@Q.add("evaluate_all", f"SELECT forecast, {r(*_MEANS)} FROM scores GROUP BY forecast", _scored("baseline_rows"))
def _(spark, sf):
    return ev.evaluate(fx.tracks(spark, sf), HISTORY, STEPS).summary


@Q.add(
    "short_storms",
    "SELECT storm_id, count(*) AS n_fixes FROM tracks GROUP BY storm_id HAVING count(*) < 60",
)
def _(spark, sf):
    return ev.evaluate(fx.tracks(spark, sf), 40, 20).short_storms


_NULLABLE = [m for m in mt.DEFAULT_METRICS if m != "rapid_intensification_skill"]
_WITH_MODEL = {
    **_scored("all_rows"),
    "all_rows": "SELECT * FROM baseline_rows UNION ALL SELECT * FROM analog_rows",
    "all_scores": f"""
        SELECT * FROM scores UNION ALL
        SELECT storm_id, 'analog', {", ".join("NULL" for _ in _NULLABLE)}, 0e0 FROM motion WHERE wind0 > 100""",
}


@Q.add(
    "evaluate_with_model",
    f"SELECT storm_id, forecast, {r(*mt.DEFAULT_METRICS)} FROM all_scores",
    _WITH_MODEL,
)
def _(spark, sf):
    return ev.evaluate(
        fx.tracks(spark, sf), HISTORY, STEPS, models=_analog(spark, sf), model_names=["analog"]
    ).per_storm


_STRICT = [f"CASE WHEN count({m}) = count(*) THEN avg({m}) END AS {m}" for m in mt.DEFAULT_METRICS]


@Q.add(
    "score_summary_strict",
    f"SELECT forecast, {r(*_STRICT)} FROM all_scores GROUP BY forecast",
    _WITH_MODEL,
)
def _(spark, sf):
    return ev.evaluate(
        fx.tracks(spark, sf), HISTORY, STEPS, models=_analog(spark, sf), model_names=["analog"]
    ).summary


_GAIN = "\nUNION ALL ".join(
    f"SELECT forecast, '{m}' AS metric, (b - {m}) / nullif(b, 0) * 100e0 AS gain"
    f" FROM means, (SELECT {m} AS b FROM means WHERE forecast = 'persistence')"
    for m in mt.DEFAULT_METRICS
)


@Q.add(
    "improvement_pct",
    f"SELECT forecast, metric, {r('gain AS improvement_pct')} FROM gains",
    {
        **_scored("baseline_rows"),
        "means": f"SELECT forecast, {', '.join(_MEANS)} FROM scores GROUP BY forecast",
        "gains": _GAIN,
    },
)
def _(spark, sf):
    return mt.improvement_pct(ev.evaluate(fx.tracks(spark, sf), HISTORY, STEPS).summary, "persistence")


@Q.add(
    "custom_metric",
    f"SELECT storm_id, forecast, {r('max(abs(wind - true_wind)) AS worst_wind_error')} FROM pairs GROUP BY storm_id, forecast",
    _scored("baseline_rows"),
)
def _(spark, sf):
    cases, _short = mt.storm_cases(fx.tracks(spark, sf), HISTORY, STEPS)
    pairs = mt.baseline_pairs(cases, STEPS, bl.DEFAULT_BASELINES)
    return mt.score_with_python(
        pairs, "worst_wind_error", lambda rows: float((rows["wind"] - rows["true_wind"]).abs().max())
    )


# -- written and read back -----------------------------------------------------------------------


def _folder(spark, name):
    return f"{staging.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@Q.add(
    "scores_written",
    f"SELECT kind, storm_id, forecast, {r(*mt.DEFAULT_METRICS)} FROM scores, (VALUES ('csv'), ('json')) AS k(kind)",
    _scored("baseline_rows"),
)
def _(spark, sf):
    scores = ev.evaluate(fx.tracks(spark, sf), HISTORY, STEPS).per_storm
    base = _folder(spark, "scores")
    sinks.write_scores(scores, f"{base}/table")
    sinks.write_scores(scores, f"{base}/table.json")
    csv = spark.read.schema(scores.schema).option("header", True).csv(f"{base}/table").withColumn("kind", F.lit("csv"))
    return csv.unionByName(spark.read.schema(scores.schema).json(f"{base}/table.json").withColumn("kind", F.lit("json")))


@Q.add(
    "storm_dataset_written",
    f"""SELECT 'track' AS part, storm_id, "timestamp" AS "time", {r("latitude", "max_wind AS value")} FROM tracks UNION ALL
        SELECT 'track by storm', storm_id, "timestamp", {r("latitude", "max_wind AS value")} FROM tracks UNION ALL
        SELECT 'grid', NULL, "time", {r("latitude", "msl AS value")} FROM grid""",
)
def _(spark, sf):
    tracks, grid = fx.tracks(spark, sf), fx.grid(spark, sf)
    base = _folder(spark, "dataset")
    sinks.write_storm_dataset(tracks, base, grid)
    sinks.write_storm_dataset(tracks, f"{base}-by-storm", per_storm=True)

    def part(rows, name, time, value, storm):
        return rows.select(F.lit(name).alias("part"), storm.cast("string").alias("storm_id"), F.col(time).alias("time"), "latitude", F.col(value).alias("value"))

    found = part(spark.read.parquet(f"{base}/track"), "track", "timestamp", "max_wind", F.col("storm_id"))
    by_storm = sinks.read_by_storm(spark, f"{base}-by-storm/track", tracks.schema)
    found = found.unionByName(part(by_storm, "track by storm", "timestamp", "max_wind", F.col("storm_id")))
    return found.unionByName(part(spark.read.parquet(f"{base}/grid"), "grid", "time", "msl", F.lit(None)))


@Q.add(
    "stats_written",
    f"""SELECT variable, {r("avg(value) AS mean", "stddev_pop(value) AS std")} FROM (
          SELECT 'u10' AS variable, u10 AS value FROM grid UNION ALL SELECT 'msl', msl FROM grid) GROUP BY variable""",
)
def _(spark, sf):
    path = _folder(spark, "stats")
    sinks.save_stats(gr.grid_stats_fit(fx.grid(spark, sf), ["u10", "msl"]), path)
    return sinks.load_stats(spark, path)


@Q.add(
    "missing_scores",
    "\nUNION ALL ".join(f"SELECT '{m}' AS metric, count(*) - count({m}) AS n_missing FROM all_scores" for m in mt.DEFAULT_METRICS),
    _WITH_MODEL,
)
def _(spark, sf):
    scored = ev.evaluate(fx.tracks(spark, sf), HISTORY, STEPS, models=_analog(spark, sf), model_names=["analog"])
    return sinks.missing_scores(scored.per_storm)


@Q.add(
    "custom_baseline",
    f"""SELECT storm_id, forecast, step, {r("lat0 + 0.25e0 * step AS latitude", "lon0 AS longitude")}, wind0 AS max_wind
        FROM motion, (VALUES ('northward')) AS m(forecast), range(1, {STEPS + 1}) AS s(step) UNION ALL
        SELECT storm_id, forecast, step, {r("lat AS latitude", "lon AS longitude")}, wind FROM baseline_rows WHERE forecast = 'gfs'""",
    _CASES,
)
def _(spark, sf):
    def northward(history, steps):
        last = bl.recent_motion(history, "step").select("storm_id", "last.*")
        rows = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
        return rows.withColumn("latitude", F.col("latitude") + F.col("step") * 0.25)

    bl.register_baseline("northward", northward)
    try:
        return bl.baseline_forecasts(_history(spark, sf), STEPS, ["gfs", "northward"], "step")
    finally:
        bl._BUILDERS.pop("northward")


@Q.add(
    "custom_metric_partial",
    f"""SELECT forecast, {r("sqrt(avg((wind - true_wind) * (wind - true_wind))) AS wind_rmse")} FROM pairs GROUP BY forecast""",
    _scored("baseline_rows"),
)
def _(spark, sf):
    cases, _short = mt.storm_cases(fx.tracks(spark, sf), HISTORY, STEPS)
    pairs = mt.baseline_pairs(cases, STEPS, bl.DEFAULT_BASELINES)

    def partial(rows):
        off = (rows["wind"] - rows["true_wind"]).dropna()
        return [len(off), float((off * off).sum())]

    return mt.score_with_partials(
        pairs, "wind_rmse", partial, lambda a, b: [x + y for x, y in zip(a, b)], lambda s: (s[1] / s[0]) ** 0.5 if s[0] else None,
        by=["forecast"],
    )


@Q.add(
    "model_forecast",
    f"""SELECT storm_id, 'damped' AS forecast, step, {r("lat0 + dlat * 0.5e0 * step AS latitude",
        "lon0 + dlon * 0.5e0 * step AS longitude")}, wind0 AS max_wind FROM motion, range(1, {STEPS + 1}) AS s(step)""",
    _CASES,
)
def _(spark, sf):
    def damped(features, steps, step_hours):
        import pandas as pd

        recent = features[["latitude", "longitude"]].tail(6)
        move = (recent.iloc[-1] - recent.iloc[0]) / (len(recent) - 1)
        last = features.iloc[-1]
        return pd.DataFrame(
            [
                {
                    "latitude": last["latitude"] + move["latitude"] * 0.5 * s,
                    "longitude": last["longitude"] + move["longitude"] * 0.5 * s,
                    "max_wind": last["max_wind"],
                }
                for s in range(1, steps + 1)
            ]
        )

    made = hooks.storm_forecaster(_history(spark, sf), damped, STEPS, name="damped", order="step")
    return made.drop("error")


@Q.add(
    "model_errors",
    """SELECT storm_id, count(*) AS n_steps, CASE WHEN wind0 > 100 THEN 'ValueError: too strong' END AS error
       FROM motion, range(1, 3) AS s(step) GROUP BY storm_id, wind0""",
    _CASES,
)
def _(spark, sf):
    def picky(features, steps, step_hours):
        if features.iloc[-1]["max_wind"] > 100:
            raise ValueError("too strong")
        return features.tail(1).loc[lambda f: f.index.repeat(steps)]

    made = hooks.storm_forecaster(_history(spark, sf), picky, 2, name="picky", order="step")
    return made.groupBy("storm_id", "error").agg(F.count(F.lit(1)).alias("n_steps"))


# -- ensembles ---------------------------------------------------------------------------------

_STATE = ["latitude", "longitude", "max_wind"]
_BY = ["storm_id", "step"]


def _members(function):
    return r(*[f"{function.format(c)} AS {name}" for c, name in (("lat", "latitude"), ("lon", "longitude"), ("wind", "max_wind"))])


@Q.add("ensemble_mean", f"SELECT storm_id, step, {_members('avg({})')} FROM baseline_rows GROUP BY storm_id, step", _CASES)
def _(spark, sf):
    return en.ensemble_mean(_baselines(spark, sf, None), _BY, _STATE)


@Q.add("ensemble_median", f"SELECT storm_id, step, {_members('median({})')} FROM baseline_rows GROUP BY storm_id, step", _CASES)
def _(spark, sf):
    return en.ensemble_median(_baselines(spark, sf, None), _BY, _STATE)


_W = "CASE forecast WHEN 'gfs' THEN 0.5e0 WHEN 'ecmwf' THEN 0.5e0 END"


@Q.add(
    "ensemble_blend",
    f"""SELECT storm_id, step, {_members("sum({} * " + _W + ") / sum(" + _W + ")")} FROM baseline_rows
        WHERE forecast IN ('gfs', 'ecmwf') GROUP BY storm_id, step""",
    _CASES,
)
def _(spark, sf):
    return en.ensemble_blend(_baselines(spark, sf, None), {"gfs": 0.5, "ecmwf": 0.5}, _BY, _STATE)


_CRPS = """SELECT case_id, n_members, {score} FROM (
          SELECT case_id, count(*) AS n_members,
            avg(abs(member - observed)) - sum((2 * rnk - n - 1) * member) / max(n * n) AS crps
          FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY member) AS rnk,
                  count(*) OVER (PARTITION BY case_id) AS n FROM {members}) GROUP BY case_id)"""


@Q.add(
    "crps_nan",
    _CRPS.format(score=r("crps"), members="known"),
    {
        "known": """
        SELECT l_orderkey AS case_id, ln(l_extendedprice) AS member, CASE WHEN l_orderkey % 10 <> 0 THEN ln(o_totalprice) END AS observed
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber % 3 <> 0"""
    },
)
def _(spark, sf):
    lines, orders = fx.table(spark, sf, "lineitem"), fx.table(spark, sf, "orders")
    members = lines.withColumn("member", F.ln("l_extendedprice"))
    members = fx.with_nan(members, "member", F.col("l_linenumber") % 3 == 0).withColumnRenamed("l_orderkey", "case_id")
    observed = orders.withColumn("observed", F.ln("o_totalprice"))
    observed = fx.with_nan(observed, "observed", F.col("o_orderkey") % 10 == 0).withColumnRenamed("o_orderkey", "case_id")
    return en.crps_ensemble(members, observed, ["case_id"], "member", "observed")


@Q.add(
    "median_nan",
    """SELECT o_custkey AS case_id, round(median(o_totalprice), 6) + 0e0 AS price FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY o_custkey""",
)
def _(spark, sf):
    orders = fx.table(spark, sf, "orders").withColumns({"case_id": F.col("o_custkey"), "price": F.col("o_totalprice").cast("double")})
    return en.ensemble_median(fx.with_nan(orders, "price", F.col("o_orderkey") % 7 == 0), ["case_id"], ["price"])


_NAN_SCORES = ["track_error", "intensity_mae"]
_NAN_TRUTH = {
    **_scored("baseline_rows"),
    "steps": _CASES["steps"].replace("FROM tracks", "FROM tracks_nan"),
    "complete": f"""
        SELECT storm_id, forecast, {", ".join(f"CASE WHEN count({c}) = count(*) THEN avg({c}) END AS {m}"
            for m, c in (("track_error", "CASE WHEN lat + true_lat IS NOT NULL THEN km END"), ("intensity_mae", "abs(wind - true_wind)")))}
        FROM plane GROUP BY storm_id, forecast""",
}


@Q.add("score_nan_truth", f"SELECT storm_id, forecast, {r(*_NAN_SCORES)} FROM complete", _NAN_TRUTH)
def _(spark, sf):
    return ev.evaluate(fx.tracks_nan(spark, sf), HISTORY, STEPS, metrics=_NAN_SCORES).per_storm


@Q.add(
    "crps_ensemble",
    f"""SELECT case_id, n_members, {r("crps")} FROM (
          SELECT case_id, count(*) AS n_members,
            avg(abs(member - observed)) - sum((2 * rnk - n - 1) * member) / max(n * n) AS crps
          FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY member) AS rnk,
                  count(*) OVER (PARTITION BY case_id) AS n FROM ensemble) GROUP BY case_id)""",
)
def _(spark, sf):
    members = fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.ln("l_extendedprice").alias("member")
    )
    observed = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.ln("o_totalprice").alias("observed")
    )
    return en.crps_ensemble(members, observed, ["case_id"], "member", "observed")


@Q.add(
    "reliability_curve",
    f"""SELECT CAST(least(greatest(ceil(probability * 10), 1), 10) AS BIGINT) AS bin,
          {r("avg(probability) AS mean_probability", "avg(CASE WHEN event THEN 1e0 ELSE 0e0 END) AS event_frequency")},
          count(*) AS n_cases FROM event_probabilities GROUP BY 1""",
)
def _(spark, sf):
    return en.reliability_curve(fx.event_probabilities(spark, sf), "probability", "event")
