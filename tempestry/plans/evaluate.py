"""Evaluation of baselines and models over all storms."""

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tempestry.operators import baselines as bl
from tempestry.operators import metrics as mt


@dataclass
class Evaluation:
    """Lazy results: per-storm scores, their means, and storms too short to score."""

    per_storm: DataFrame
    summary: DataFrame
    short_storms: DataFrame


def evaluate(
    tracks: DataFrame,
    history: int,
    forecast: int,
    baselines: list[str] | None = None,
    metrics: list[str] | None = None,
    models: DataFrame | None = None,
    model_names: list[str] | None = None,
    strict: bool = True,
    order: str = "timestamp",
) -> Evaluation:
    """Score baselines, and model forecasts when given, on every storm.

    The first ``history`` fixes are known, the next ``forecast`` are the truth.
    ``models`` has storm_id, forecast, step, latitude, longitude, max_wind; with
    ``model_names`` a forecast missing for a storm scores NULL instead of being
    left out.
    """
    cases, short = mt.storm_cases(tracks, history, forecast, order)
    names = list(baselines or bl.DEFAULT_BASELINES)
    motion = [n for n in names if n in bl.MOTION_FACTORS and n not in bl._BUILDERS]
    custom = [n for n in names if n in bl._BUILDERS]

    parts = []
    if motion:
        parts.append(mt.baseline_pairs(cases, forecast, motion))
    if custom:
        known = cases.selectExpr("storm_id", "inline(history)").withColumnRenamed("step", order)
        made = bl.baseline_forecasts(known, forecast, custom, order)
        parts.append(mt.forecast_pairs(made, cases, forecast))
    if models is not None:
        parts.append(mt.forecast_pairs(models, cases, forecast, model_names))
    if not parts:
        raise ValueError(f"no known baseline among {names}")

    scored = [mt.score(p, metrics) for p in parts]
    per_storm = scored[0]
    for more in scored[1:]:
        per_storm = per_storm.unionByName(more)
    return Evaluation(per_storm, mt.score_summary(per_storm, strict), short)


def history_of(tracks: DataFrame, history: int, forecast: int, order: str = "timestamp"):
    """Known fixes of the storms that can be scored, for making model forecasts."""
    cases, _ = mt.storm_cases(tracks, history, forecast, order)
    return cases.selectExpr("storm_id", "inline(history)")
