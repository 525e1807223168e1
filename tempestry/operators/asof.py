"""As-of joins: for each row of one table the nearest, last or next time of another, at irregular times.

Time is cut into buckets.  The other table's distinct times become one row per bucket: the sorted times in it,
the last time before it and the first after it, carried over empty buckets by a running maximum and minimum over the
buckets.  Rows meet the row of their bucket by an equi-join and choose among those few times.  No window runs over
rows and no row is sorted, so a storm or an hour that holds most rows is split like any other join.

A bucket with more times than ``crowd`` is cut into finer ones, so what a row meets stays small however unevenly
times lie.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempestry.functions.clock import MICROS_PER_HOUR, from_micros, micros

BUCKET_HOURS = 24
CROWD = 64
DIRECTIONS = ("nearest", "backward", "forward")


def same(left: list[str], right: list[str]) -> Column:
    """Equality of columns, missing values being equal."""
    return reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)], F.lit(True))


def finer(count: Column, crowd: int) -> Column:
    """Into how many parts a bucket is cut: a power of two, one for ordinary buckets."""
    return F.when(count <= crowd, F.lit(1.0)).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(count / F.lit(float(crowd))))))


def time_table(times: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """Per bucket that is asked for or holds a time: ``_before``, ``_times`` and ``_after``.

    times: (by, _bucket, _fine, _t) distinct; wanted: (by, _bucket, _fine) distinct.
    """
    place = [*by, "_tempestry_bucket", "_tempestry_fine"]
    held = times.groupBy(*place).agg(F.array_sort(F.collect_list("_tempestry_t")).alias("_tempestry_times"))
    asked = wanted.withColumn("_tempestry_times", F.lit(None).cast("array<bigint>"))
    every = held.unionByName(asked).groupBy(*place).agg(F.max("_tempestry_times").alias("_tempestry_times"))
    over = Window.partitionBy(*by).orderBy("_tempestry_bucket", "_tempestry_fine")
    earlier, later = over.rowsBetween(Window.unboundedPreceding, -1), over.rowsBetween(1, Window.unboundedFollowing)
    return every.withColumns(
        {
            "_tempestry_before": F.max(F.array_max("_tempestry_times")).over(earlier),
            "_tempestry_after": F.min(F.array_min("_tempestry_times")).over(later),
        }
    )


def asof_join(
    rows: DataFrame,
    times: DataFrame,
    row_time: str,
    time: str,
    name: str,
    by: list[str] | None = None,
    direction: str = "nearest",
    tolerance_hours: float | None = None,
    bucket_hours: float = BUCKET_HOURS,
    crowd: int = CROWD,
) -> DataFrame:
    """All rows with the column ``name``: the chosen time of ``times``, NULL where there is none.

    ``nearest`` takes the earlier of two times equally far, ``backward`` the last one not after the row,
    ``forward`` the first one not before it.  ``tolerance_hours`` bounds how far it may be.  ``by`` names columns that
    must agree, missing values with missing ones.  Rows without a time get none; repeated rows and times are allowed.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction: {direction}")
    by = list(by or [])
    width = int(bucket_hours * MICROS_PER_HOUR)
    bucket = F.floor(F.col("_tempestry_t") / width)

    known = times.select(*by, micros(F.col(time)).alias("_tempestry_t")).where("_tempestry_t IS NOT NULL").distinct().withColumn("_tempestry_bucket", bucket)
    crowds = known.groupBy(*by, "_tempestry_bucket").agg(F.count(F.lit(1)).alias("_tempestry_n")).where(F.col("_tempestry_n") > crowd)
    crowds = crowds.select(*[F.col(c).alias(f"_tempestry_c_{c}") for c in by], F.col("_tempestry_bucket").alias("_tempestry_c"), finer(F.col("_tempestry_n"), crowd).alias("_tempestry_parts"))

    def placed(df):
        """With the fine bucket of each time; few buckets are crowded, so most rows have part 0."""
        found = df.join(crowds, same([*by, "_tempestry_bucket"], [*(f"_tempestry_c_{c}" for c in by), "_tempestry_c"]), "left")
        within = (F.col("_tempestry_t") - F.col("_tempestry_bucket") * width) / F.lit(float(width))
        fine = F.coalesce(F.floor(within * F.col("_tempestry_parts")), F.lit(0))
        return found.withColumn("_tempestry_fine", fine).drop("_tempestry_c", "_tempestry_parts", *(f"_tempestry_c_{c}" for c in by))

    asking = placed(rows.select(F.struct("*").alias("_tempestry_row"), *by, micros(F.col(row_time)).alias("_tempestry_t")).withColumn("_tempestry_bucket", bucket))
    wanted = asking.where("_tempestry_t IS NOT NULL").select(*by, "_tempestry_bucket", "_tempestry_fine").distinct()
    table = time_table(placed(known), wanted, by)
    table = table.select(*[F.col(c).alias(f"_tempestry_k_{c}") for c in [*by, "_tempestry_bucket", "_tempestry_fine"]], "_tempestry_before", "_tempestry_times", "_tempestry_after")
    keys = [*by, "_tempestry_bucket", "_tempestry_fine"]
    met = asking.join(table, same(keys, [f"_tempestry_k_{c}" for c in keys]), "left")

    near = F.concat(F.array("_tempestry_before"), F.coalesce("_tempestry_times", F.array().cast("array<bigint>")), F.array("_tempestry_after"))
    here = F.col("_tempestry_t")
    if direction == "backward":
        near = F.filter(near, lambda t: t <= here)
    elif direction == "forward":
        near = F.filter(near, lambda t: t >= here)
    else:
        near = F.filter(near, lambda t: t.isNotNull())
    # compared by distance, then by time: the earlier of two wins
    best = F.array_min(F.transform(near, lambda t: F.struct(F.abs(t - here).alias("gap"), t.alias("t"))))
    met = met.withColumn("_tempestry_best", best)
    chosen = F.col("_tempestry_best.t")
    if tolerance_hours is not None:
        chosen = F.when(F.col("_tempestry_best.gap") <= int(tolerance_hours * MICROS_PER_HOUR), chosen)
    return met.select("_tempestry_row.*", from_micros(chosen).alias(name))


def nearest_analysis(tracks: DataFrame, grid: DataFrame, tolerance_hours: float | None = None, **options) -> DataFrame:
    """Fixes with the nearest time of the grid, at whatever times it has; fixes without one within the tolerance are left out."""
    found = asof_join(tracks, grid.select("time"), "timestamp", "time", "analysis_time", tolerance_hours=tolerance_hours, **options)
    return found.where(F.col("analysis_time").isNotNull())
