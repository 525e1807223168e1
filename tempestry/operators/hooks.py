"""Where users plug in their own models.

These are the only operators that leave the JVM.  Data crosses in Arrow batches,
and a Python call sees one batch of array rows or one storm's recent fixes.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def model_score(df: DataFrame, column: str, infer: Callable, output: str = "prediction"):
    """Apply ``infer(float32 array of rows) -> array`` to an array column."""
    return model_rollout(df, column, infer, 1, output, every_step=False)


def model_rollout(
    df: DataFrame,
    column: str,
    infer: Callable,
    steps: int,
    output: str = "prediction",
    every_step: bool = False,
) -> DataFrame:
    """Feed a model its own output ``steps`` times.

    The last state is kept, or with ``every_step`` one row per step.
    """
    schema = T.StructType(list(df.schema.fields))
    if every_step:
        schema = schema.add("step", T.IntegerType())
    schema = schema.add(output, T.ArrayType(T.FloatType()))

    def run(batches):
        import numpy as np

        for batch in batches:
            if batch.empty:
                continue
            state = np.stack([np.asarray(a, dtype=np.float32) for a in batch[column]])
            for step in range(1, steps + 1):
                state = np.asarray(infer(state), dtype=np.float32)
                if every_step:
                    yield batch.assign(step=np.int32(step), **{output: list(state)})
            if not every_step:
                yield batch.assign(**{output: list(state)})

    return df.mapInPandas(run, schema)


def storm_forecaster(
    tracks: DataFrame,
    predict: Callable,
    steps: int,
    step_hours: int = 6,
    history: int = 8,
    name: str = "model",
    order: str = "timestamp",
) -> DataFrame:
    """Forecast each storm with ``predict(features, steps, step_hours)``.

    ``features`` is a pandas frame of the storm's last ``history`` fixes, so a
    group is small whatever the length of the track.  ``predict`` returns a frame
    with ``latitude, longitude, max_wind``, one row per step.  A storm it raises
    on gets missing values in every step, which scoring turns into missing scores, and the kind and text of the error in the column
    ``error``; a column of NULLs means that the model ran on every storm.
    """
    newest = Window.partitionBy("storm_id").orderBy(F.col(order).desc())
    recent = (
        tracks.withColumn("_tempestry_age", F.row_number().over(newest))
        .filter(F.col("_tempestry_age") <= history)
        .select("storm_id", order, "latitude", "longitude", "max_wind")
    )

    def one_storm(key, rows):
        import pandas as pd

        features = rows.sort_values(order).reset_index(drop=True)
        error = None
        try:
            out = predict(features, steps, step_hours).reset_index(drop=True)
            out = out[["latitude", "longitude", "max_wind"]].astype("float64")
        except Exception as failure:
            error = f"{type(failure).__name__}: {failure}"
            gap = [float("nan")] * steps
            out = pd.DataFrame({"latitude": gap, "longitude": gap, "max_wind": gap})
        out.insert(0, "step", range(1, len(out) + 1))
        out.insert(0, "forecast", name)
        out.insert(0, "storm_id", key[0])
        out["error"] = pd.Series([error] * len(out), dtype="object")
        return out

    return recent.groupBy("storm_id").applyInPandas(
        one_storm,
        "storm_id string, forecast string, step int, latitude double, longitude double, max_wind double, error string",
    )
