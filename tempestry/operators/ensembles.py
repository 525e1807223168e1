"""Ensemble statistics and probabilistic scores."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempestry.functions.geo import known
from tempestry.operators import ordered

RELIABILITY_BINS = 10


def ensemble_mean(members: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Mean over members of each case and step."""
    return members.groupBy(*by).agg(*[F.avg(c).alias(c) for c in columns])


def ensemble_median(
    members: DataFrame, by: list[str], columns: list[str], min_rows: int = ordered.MIN_HOT_ROWS
) -> DataFrame:
    """Exact median over members; missing and NaN members do not count, and without any there is no row.

    Values are exchanged once, by case and value bin (an ordinary case is one bin).  Running sums over the
    bins' counts tell which bin holds the middle, and only members of that bin are ranked.  So a case that holds a third of
    all members is never in one task.
    """
    clean = members.select(*by, *[known(F.col(c).cast("double")).alias(c) for c in columns])
    long = clean.unpivot(by, columns, "_tempestry_variable", "_tempestry_value").filter(F.col("_tempestry_value").isNotNull())
    keys = [*by, "_tempestry_variable"]
    binned = ordered.spread(ordered.with_bins(long, keys, "_tempestry_value", min_rows), keys)
    # totals read the values too, so that both uses of the exchange have the same columns and it is made once
    totals = ordered.bin_totals(binned, keys, _tempestry_lowest=F.min("_tempestry_value"))
    lower = F.floor((F.col("_tempestry_rows") + 1) / 2)
    upper = F.floor((F.col("_tempestry_rows") + 2) / 2)
    middle = totals.filter((F.col("_tempestry_before") < upper) & (F.col("_tempestry_before") + F.col("_tempestry_in") >= lower))
    inside = ordered.join_totals(binned, middle, keys)
    rank = F.row_number().over(Window.partitionBy(ordered.HOME, *keys, ordered.BIN).orderBy("_tempestry_value")) + F.col("_tempestry_before")
    chosen = inside.withColumn("_tempestry_rank", rank).filter(F.col("_tempestry_rank").between(lower, upper))
    value = F.greatest("_tempestry_value", "_tempestry_lowest")
    return chosen.groupBy(*by).agg(*[F.avg(F.when(F.col("_tempestry_variable") == c, value)).alias(c) for c in columns])


def ensemble_blend(
    members: DataFrame,
    weights: dict[str, float],
    by: list[str],
    columns: list[str],
    member: str = "forecast",
) -> DataFrame:
    """Weighted mean of named members; members without a weight stay out."""
    weight = None
    for name, value in weights.items():
        hit = F.col(member) == name
        weight = F.when(hit, F.lit(value)) if weight is None else weight.when(hit, F.lit(value))
    weighted = members.withColumn("_tempestry_weight", weight).filter(F.col("_tempestry_weight").isNotNull())
    return weighted.groupBy(*by).agg(
        *[
            F.try_divide(
                F.sum(F.col(c) * F.col("_tempestry_weight")), F.sum(F.when(F.col(c).isNotNull(), F.col("_tempestry_weight")))
            ).alias(c)
            for c in columns
        ]
    )


def crps_ensemble(
    members: DataFrame,
    observations: DataFrame,
    case: list[str],
    value: str,
    observed: str,
    min_rows: int = ordered.MIN_HOT_ROWS,
) -> DataFrame:
    """Continuous ranked probability score of each case; missing and NaN members do not count.

    Mean distance to the observation minus half the mean distance between
    members.  The second term comes from ranks, sum((2i - n - 1) x_i) / n^2, so no
    pairs of members are formed.  Members are exchanged by case and value bin, meet the observation there and are
    ranked within their bin.  What the lower bins add to a rank is put to the sums of a bin, so members of one case meet
    nowhere.  A NaN observation is a missing one: the score is missing.
    """
    x = F.col("_tempestry_x")
    narrow = members.select(*case, known(F.col(value).cast("double")).alias("_tempestry_x")).filter(x.isNotNull())
    truth = observations.select(*case, known(F.col(observed).cast("double")).alias("_tempestry_y"))
    binned = ordered.with_bins(narrow, case, "_tempestry_x", min_rows)
    # an observation goes to bin 0, and to each further bin of a large case
    further = binned.where(F.col(ordered.LARGE) & (F.col(ordered.BIN) > 0)).select(*case, ordered.BIN).distinct()
    sent = truth.withColumn(ordered.BIN, F.lit(0).cast("long")).unionByName(further.join(truth, case))
    sent = sent.withColumn(ordered.HOME, F.xxhash64(*case, ordered.BIN))
    placed = ordered.join_totals(ordered.spread(binned, case), sent, case)
    rank = F.row_number().over(Window.partitionBy(ordered.HOME, *case, ordered.BIN).orderBy("_tempestry_x"))
    parts = placed.withColumn("_tempestry_rank", rank).groupBy(ordered.HOME, *case, ordered.BIN).agg(
        F.count(F.lit(1)).alias("_tempestry_in"),
        F.sum(F.col("_tempestry_rank") * x).alias("_tempestry_ranked"),
        F.sum(x).alias("_tempestry_sum"),
        F.sum(F.abs(x - F.col("_tempestry_y"))).alias("_tempestry_off"),
    )
    earlier = Window.partitionBy(*case).orderBy(ordered.BIN).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_tempestry_in").over(earlier), F.lit(0))
    shifted = parts.withColumn("_tempestry_ranked", F.col("_tempestry_ranked") + before * F.col("_tempestry_sum"))
    n = F.sum("_tempestry_in")
    spread = (F.sum("_tempestry_ranked") * 2.0 - (n + 1) * F.sum("_tempestry_sum")) / (n * n)
    return shifted.groupBy(*case).agg(n.alias("n_members"), (F.sum("_tempestry_off") / n - spread).alias("crps"))


def reliability_curve(
    cases: DataFrame, probability: str, event: str, bins: int = RELIABILITY_BINS
) -> DataFrame:
    """Mean probability and event frequency in equal bins (lo, hi], the first closed.

    Cases without a probability are in no bin.
    """
    p = F.col(probability)
    number = F.least(F.greatest(F.ceil(p * bins), F.lit(1)), F.lit(bins)).cast("int")
    return (
        cases.filter(p.isNotNull())
        .groupBy(number.alias("bin"))
        .agg(
            F.avg(p).alias("mean_probability"),
            F.avg(F.col(event).cast("double")).alias("event_frequency"),
            F.count(F.lit(1)).alias("n_cases"),
        )
    )
