"""Conservation losses with their gradients, and relative conservation errors.

The input holds prediction and truth side by side.  ``by`` names the columns that
identify one field (for example the time); without it the whole table is one field.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempestry.operators.grid import grid_kinematics
from tempestry.schema import GRID_COORDS

# Heat capacity of dry air at constant pressure, gravity.
HEAT_CAPACITY = 1004.0
GRAVITY = 9.81


def _totals(pairs: DataFrame, by: list[str], totals: dict[str, Column]) -> tuple[DataFrame, dict]:
    """Attach group totals to the rows; totals are partial aggregates."""
    per_field = pairs.groupBy(*by).agg(*[c.alias(n) for n, c in totals.items()])
    if by:
        return pairs.join(per_field, by), {n: F.col(n) for n in totals}
    rows = pairs.withColumn("_tempestry_totals", per_field.select(F.struct(*totals)).scalar())
    return rows.select("*", "_tempestry_totals.*").drop("_tempestry_totals"), {n: F.col(n) for n in totals}


def loss_mse(pairs: DataFrame, pred: str, truth: str, by: list[str] | None = None) -> DataFrame:
    """Mean squared error and its gradient at every cell."""
    diff = F.col(pred) - F.col(truth)
    rows, total = _totals(
        pairs, by or [], {"_tempestry_loss": F.avg(diff * diff), "_tempestry_n": F.count(F.lit(1))}
    )
    return rows.withColumns({"loss": total["_tempestry_loss"], "gradient": diff * 2.0 / total["_tempestry_n"]}).drop(
        "_tempestry_loss", "_tempestry_n"
    )


def loss_mass(pairs: DataFrame, pred: str, truth: str, by: list[str] | None = None) -> DataFrame:
    """Squared difference of the sums; the gradient is the same in every cell."""
    rows, total = _totals(pairs, by or [], {"_tempestry_gap": F.sum(pred) - F.sum(truth)})
    gap = total["_tempestry_gap"]
    return rows.withColumns({"loss": gap * gap, "gradient": gap * 2.0}).drop("_tempestry_gap")


def loss_momentum(
    pairs: DataFrame,
    pred: tuple[str, str],
    truth: tuple[str, str],
    by: list[str] | None = None,
) -> DataFrame:
    """Squared difference of the summed wind vectors."""
    rows, total = _totals(
        pairs,
        by or [],
        {
            "_tempestry_gap_u": F.sum(pred[0]) - F.sum(truth[0]),
            "_tempestry_gap_v": F.sum(pred[1]) - F.sum(truth[1]),
        },
    )
    gap_u, gap_v = total["_tempestry_gap_u"], total["_tempestry_gap_v"]
    return rows.withColumns(
        {
            "loss": gap_u * gap_u + gap_v * gap_v,
            "gradient_u": gap_u * 2.0,
            "gradient_v": gap_v * 2.0,
        }
    ).drop("_tempestry_gap_u", "_tempestry_gap_v")


def loss_kinetic(
    pairs: DataFrame,
    pred: tuple[str, str],
    truth: tuple[str, str],
    by: list[str] | None = None,
) -> DataFrame:
    """Mean squared difference of kinetic energy."""

    def energy(names):
        u, v = F.col(names[0]), F.col(names[1])
        return (u * u + v * v) * 0.5

    diff = energy(pred) - energy(truth)
    rows, total = _totals(
        pairs, by or [], {"_tempestry_loss": F.avg(diff * diff), "_tempestry_n": F.count(F.lit(1))}
    )
    slope = diff * 2.0 / total["_tempestry_n"]
    return rows.withColumns(
        {
            "loss": total["_tempestry_loss"],
            "gradient_u": slope * F.col(pred[0]),
            "gradient_v": slope * F.col(pred[1]),
        }
    ).drop("_tempestry_loss", "_tempestry_n")


def conserved_totals(fields: DataFrame) -> DataFrame:
    """Mass, total energy and vorticity of each time, summed over weighted cells.

    Expects ``time, latitude, longitude, density, u, v, temperature, height,
    weight``, the weight being the volume a cell stands for.
    """
    rho, u, v = F.col("density"), F.col("u"), F.col("v")
    energy = (
        rho * (u * u + v * v) * 0.5
        + rho * F.col("temperature") * HEAT_CAPACITY
        + rho * F.col("height") * GRAVITY
    )
    spun = grid_kinematics(fields, "u", "v", "field")
    return spun.groupBy("time").agg(
        F.sum(rho * F.col("weight")).alias("mass"),
        F.sum(energy * F.col("weight")).alias("energy"),
        F.sum(F.col("vorticity_field") * F.col("weight")).alias("vorticity"),
    )


def conservation_errors(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Relative errors of the three totals, averaged over time."""
    totals = ["mass", "energy", "vorticity"]
    p = conserved_totals(predicted)
    t = conserved_totals(truth).withColumnsRenamed({q: f"_tempestry_true_{q}" for q in totals})
    joined = p.join(t, "time")

    def error(q):
        gap = F.abs(F.col(q) - F.col(f"_tempestry_true_{q}"))
        return F.avg(F.try_divide(gap, F.abs(F.col(f"_tempestry_true_{q}")))).alias(f"{q}_error")

    return joined.agg(*[error(q) for q in totals])


def with_cell_weight(grid: DataFrame) -> DataFrame:
    """Weight of a regular grid cell: cosine of its latitude."""
    missing = [c for c in GRID_COORDS if c not in grid.columns]
    if missing:
        raise ValueError(f"not a grid, missing {missing}")
    return grid.withColumn("weight", F.cos(F.radians("latitude")))
