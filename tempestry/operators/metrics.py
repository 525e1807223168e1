"""Forecast scores.

Scores are computed from *pairs*: one row per storm, forecast and step with the
predicted fix, the true fix, the true fix before it, the storm's mean true
latitude and both winds four steps earlier.  ``storm_cases`` keeps the few
history and truth fixes of a storm together in one row, so pairing needs no join
of step rows, and everything after it stays partitioned by storm.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempestry.functions.geo import east_km, haversine_km, known, north_km
from tempestry.operators.baselines import MOTION_STEPS, _method_array
from tempestry.operators.tracks import history_truth_split

RI_STEPS = 4
RI_KNOTS = 30.0
IDS = ["storm_id", "forecast"]


# -- cases and pairs ---------------------------------------------------------------------------


def storm_cases(
    tracks: DataFrame, history: int, forecast: int, order: str = "timestamp"
) -> tuple[DataFrame, DataFrame]:
    """(cases, short storms): storms with and without enough fixes to be scored.

    NaN is a missing value, in the truth as in the history.
    A case holds ``history + forecast`` fixes as two arrays; longer tracks never
    reach it because the row-number bound is applied before the exchange.
    """
    measured = ["latitude", "longitude", "max_wind"]
    clean = tracks.withColumns({c: known(F.col(c).cast("double")) for c in measured})
    first = history_truth_split(clean, history, forecast, order)
    fix = F.struct("step", "latitude", "longitude", "max_wind")
    grouped = first.groupBy("storm_id").agg(
        F.count(F.lit(1)).alias("n_fixes"), F.sort_array(F.collect_list(fix)).alias("_tempestry_fixes")
    )
    complete = F.col("n_fixes") == history + forecast
    cases = grouped.filter(complete).select(
        "storm_id",
        F.slice("_tempestry_fixes", 1, history).alias("history"),
        F.slice("_tempestry_fixes", history + 1, forecast).alias("truth"),
    )
    return cases, grouped.filter(~complete).select("storm_id", "n_fixes")


def _truth_columns(forecast_steps: int) -> dict[str, Column]:
    """Columns of a pair that come from the truth array at ``step``."""
    step = F.col("step")

    def at(index, field):
        return F.try_element_at(F.col("truth"), index)[field]

    def earlier(lag, field):
        return F.when(step > lag, at(F.greatest(step - lag, F.lit(1)), field))

    total = F.aggregate("truth", F.lit(0.0), lambda acc, fix: acc + fix["latitude"])
    return {
        "true_lat": at(step, "latitude"),
        "true_lon": at(step, "longitude"),
        "true_wind": at(step, "max_wind"),
        "before_lat": earlier(1, "latitude"),
        "before_lon": earlier(1, "longitude"),
        "wind_base": earlier(RI_STEPS, "max_wind"),
        "reference_lat": total / F.lit(forecast_steps),
    }


def baseline_pairs(cases: DataFrame, forecast_steps: int, methods: list[str]) -> DataFrame:
    """Pairs of the motion baselines, row by row from the cases."""
    size = F.size("history")
    last = F.element_at("history", size)
    first_index = F.greatest(size - MOTION_STEPS, F.lit(1))
    first = F.element_at("history", first_index)
    moves = size - first_index

    def mean_move(axis):
        return F.when(moves > 0, (last[axis] - first[axis]) / moves).otherwise(F.lit(0.0))

    moving = cases.select(
        "storm_id",
        "truth",
        last.alias("_tempestry_last"),
        mean_move("latitude").alias("_tempestry_dlat"),
        mean_move("longitude").alias("_tempestry_dlon"),
        F.inline(_method_array(methods)),
    ).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(forecast_steps))))
    return moving.select(
        *IDS,
        "step",
        (F.col("_tempestry_last.latitude") + F.col("_tempestry_dlat") * F.col("factor") * F.col("step")).alias("lat"),
        (F.col("_tempestry_last.longitude") + F.col("_tempestry_dlon") * F.col("factor") * F.col("step")).alias("lon"),
        F.col("_tempestry_last.max_wind").alias("wind"),
        F.when(F.col("step") > RI_STEPS, F.col("_tempestry_last.max_wind")).alias("forecast_base"),
        *[column.alias(name) for name, column in _truth_columns(forecast_steps).items()],
    )


def forecast_pairs(
    forecasts: DataFrame, cases: DataFrame, forecast_steps: int, names: list[str] | None = None
) -> DataFrame:
    """Pairs of forecasts made elsewhere (storm_id, forecast, step, position, wind).

    With ``names`` every case is expected from each named forecast, and what is
    missing is paired as NULL; otherwise only storms that were forecast count.
    """
    truth = cases.select("storm_id", "truth")
    predicted = forecasts.select(
        *IDS,
        "step",
        known(F.col("latitude")).alias("lat"),
        known(F.col("longitude")).alias("lon"),
        known(F.col("max_wind")).alias("wind"),
    )
    if names:
        expected = truth.withColumn(
            "forecast", F.explode(F.array(*[F.lit(n) for n in names]))
        ).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(forecast_steps))))
        joined = expected.join(predicted, [*IDS, "step"], "left")
    else:
        joined = predicted.join(truth, "storm_id").filter(F.col("step") <= forecast_steps)
    by_step = Window.partitionBy(*IDS).orderBy("step")
    paired = joined.withColumn("forecast_base", F.lag("wind", RI_STEPS).over(by_step))
    return paired.select(
        *IDS,
        "step",
        "lat",
        "lon",
        "wind",
        "forecast_base",
        *[column.alias(name) for name, column in _truth_columns(forecast_steps).items()],
    )


# -- metrics -----------------------------------------------------------------------------------


def complete_mean(value: Column, counted: Column | None = None) -> Column:
    """Mean that is NULL when a counted value is missing, or none is counted."""
    counts = F.lit(True) if counted is None else counted
    missing = F.count(F.when(counts & value.isNull(), 1))
    return F.when(missing == 0, F.avg(F.when(counts, value)))


def with_errors(pairs: DataFrame) -> DataFrame:
    """Error columns the metrics aggregate.

    ``km`` great-circle distance, ``wind_error``, ``along_km`` and ``cross_km``
    components of the error in the plane at the mean true latitude (NULL where the
    truth did not move, flagged by ``moved``), and whether intensification was
    forecast (``said``) and happened (``seen``).
    """
    ref = F.col("reference_lat")
    placed = pairs.select(
        *IDS,
        "step",
        haversine_km(F.col("lat"), F.col("lon"), F.col("true_lat"), F.col("true_lon")).alias("km"),
        (F.col("wind") - F.col("true_wind")).alias("wind_error"),
        (east_km(F.col("true_lon"), ref) - east_km(F.col("before_lon"), ref)).alias("_tempestry_mx"),
        (north_km(F.col("true_lat")) - north_km(F.col("before_lat"))).alias("_tempestry_my"),
        (east_km(F.col("lon"), ref) - east_km(F.col("true_lon"), ref)).alias("_tempestry_ex"),
        (north_km(F.col("lat")) - north_km(F.col("true_lat"))).alias("_tempestry_ey"),
        F.coalesce(F.col("wind") - F.col("forecast_base") >= RI_KNOTS, F.lit(False)).alias("said"),
        F.coalesce(F.col("true_wind") - F.col("wind_base") >= RI_KNOTS, F.lit(False)).alias("seen"),
    )
    length = F.sqrt(F.col("_tempestry_mx") * F.col("_tempestry_mx") + F.col("_tempestry_my") * F.col("_tempestry_my"))
    along = F.col("_tempestry_ex") * F.col("_tempestry_mx") + F.col("_tempestry_ey") * F.col("_tempestry_my")
    cross = F.col("_tempestry_mx") * F.col("_tempestry_ey") - F.col("_tempestry_my") * F.col("_tempestry_ex")
    return placed.withColumn("_tempestry_length", length).select(
        *IDS,
        "step",
        "km",
        "wind_error",
        F.coalesce(F.col("_tempestry_length") > 0, F.lit(False)).alias("moved"),
        F.abs(F.try_divide(along, F.col("_tempestry_length"))).alias("along_km"),
        F.abs(F.try_divide(cross, F.col("_tempestry_length"))).alias("cross_km"),
        "said",
        "seen",
    )


def _rapid_intensification_f1() -> Column:
    """F1 of intensification events; 0 without a hit or with fewer than five steps."""
    hits = F.count_if(F.col("said") & F.col("seen"))
    misses = F.count_if(~F.col("said") & F.col("seen"))
    alarms = F.count_if(F.col("said") & ~F.col("seen"))
    precision, recall = F.try_divide(hits, hits + alarms), F.try_divide(hits, hits + misses)
    f1 = F.try_divide(precision * recall * 2.0, precision + recall)
    return F.when(hits > 0, f1).otherwise(F.lit(0.0))


Metric = Callable[[], Column]

METRICS: dict[str, Metric] = {
    "track_error": lambda: complete_mean(F.col("km")),
    "track_rmse": lambda: F.sqrt(complete_mean(F.col("km") * F.col("km"))),
    "along_track_error": lambda: complete_mean(F.col("along_km"), F.col("moved")),
    "cross_track_error": lambda: complete_mean(F.col("cross_km"), F.col("moved")),
    "intensity_mae": lambda: complete_mean(F.abs("wind_error")),
    "intensity_rmse": lambda: F.sqrt(complete_mean(F.col("wind_error") * F.col("wind_error"))),
    "rapid_intensification_skill": _rapid_intensification_f1,
}
DEFAULT_METRICS = list(METRICS)


def register_metric(name: str, build: Metric) -> None:
    """Add a metric: a function returning an aggregate over the columns of ``with_errors``."""
    METRICS[name] = build


def score(pairs: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """One row per storm and forecast; unknown metric names are skipped."""
    chosen = [m for m in (metrics or DEFAULT_METRICS) if m in METRICS]
    if not chosen:
        raise ValueError("no known metric requested")
    errors = with_errors(pairs)
    return errors.groupBy(*IDS).agg(*[METRICS[m]().alias(m) for m in chosen])


def score_with_python(
    pairs: DataFrame, name: str, function: Callable, result_type: str = "double"
) -> DataFrame:
    """A metric that needs Python: ``function(pandas frame of one forecast) -> float``.

    A group is one storm's forecast, ``forecast_steps`` rows.
    """
    import pandas as pd

    def one_forecast(key, rows):
        value = function(rows.sort_values("step"))
        return pd.DataFrame({"storm_id": [key[0]], "forecast": [key[1]], name: [value]})

    return pairs.groupBy(*IDS).applyInPandas(
        one_forecast, f"storm_id string, forecast string, `{name}` {result_type}"
    )


def score_with_partials(
    pairs: DataFrame,
    name: str,
    partial: Callable,
    merge: Callable,
    finish: Callable,
    by: list[str] | None = None,
    result_type: str = "double",
    held: int = 10_000,
) -> DataFrame:
    """A Python metric of groups of any size, by states that can be merged.

    ``partial(pandas frame) -> list of floats`` sums up some rows of one group, ``merge(state, state) -> state`` joins two
    states, ``finish(state) -> value`` ends them.  Each task merges the states of its batches, at most ``held`` groups
    at a time, and only states are exchanged: a group meets as one state per task, never as its rows.
    """
    keys = list(by or IDS)
    kinds = dict(pairs.dtypes)
    key_schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def packed(states):
        import pandas as pd

        frame = pd.DataFrame(list(states), columns=keys, dtype="object")
        frame["state"] = [list(map(float, s)) for s in states.values()]
        return frame

    def sum_up(batches):
        states = {}
        for batch in batches:
            for key, rows in batch.groupby(keys, dropna=False, sort=False):
                state = partial(rows)
                states[key] = merge(states[key], state) if key in states else state
            if len(states) > held:
                yield packed(states)
                states = {}
        if states:
            yield packed(states)

    def end(key, rows):
        import pandas as pd

        state, *others = rows["state"]
        for other in others:
            state = merge(state, other)
        return pd.DataFrame([[*key, finish(state)]], columns=[*keys, name])

    states = pairs.mapInPandas(sum_up, f"{key_schema}, state array<double>")
    return states.groupBy(*keys).applyInPandas(end, f"{key_schema}, `{name}` {result_type}")


def score_summary(scores: DataFrame, strict: bool = False) -> DataFrame:
    """Mean of per-storm scores by forecast.

    ``strict`` makes a mean NULL when any storm's score is; otherwise missing
    scores are left out.
    """
    metrics = [c for c in scores.columns if c not in IDS]
    mean = complete_mean if strict else F.avg
    return scores.groupBy("forecast").agg(*[mean(F.col(m)).alias(m) for m in metrics])


def improvement_pct(summary: DataFrame, baseline: str) -> DataFrame:
    """Percentage by which each forecast lowers each mean score of a baseline.

    The summary has one row per forecast, and is matched with the baseline's row
    metric by metric.
    """
    metrics = [c for c in summary.columns if c != "forecast"]
    long = summary.unpivot(["forecast"], metrics, "metric", "score")
    base = long.filter(F.col("forecast") == baseline).select(
        "metric", F.col("score").alias("_tempestry_base")
    )
    gain = F.try_divide(F.col("_tempestry_base") - F.col("score"), F.col("_tempestry_base")) * 100.0
    return long.join(base, "metric").select("forecast", "metric", gain.alias("improvement_pct"))
