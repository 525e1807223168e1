"""Selections, catalogues and summaries of the track table."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempestry.functions.intensity import storm_category
from tempestry.operators.ordered import POINT

# The default season split.
SEASON_YEARS = {
    "train": list(range(2010, 2020)),
    "validation": [2020, 2021],
    "test": [2022, 2023],
}


def required(rows: DataFrame, message: str) -> DataFrame:
    """The rows; an error with this message, when the plan is run, if there are none.

    Whether there is one is asked by a subquery that stops at the first.
    """
    one = rows.select(F.lit(1).alias("one")).limit(1).agg(F.count("one").alias("n"))
    there = F.when(F.col("n") == 0, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))
    return rows.filter(one.select(there.alias("there")).scalar())


def storm_by_id(tracks: DataFrame, storm_id: str) -> DataFrame:
    """Fixes of one storm in time order; an unknown storm is an error when the plan is run."""
    rows = tracks.filter(F.col("storm_id") == storm_id)
    return required(rows, f"storm {storm_id} is not in the track table").orderBy("timestamp")


def storms_by_year(tracks: DataFrame, year: int) -> DataFrame:
    """Ids of storms with at least one fix in the year."""
    return (
        tracks.filter(F.year("timestamp") == year).select("storm_id").distinct().orderBy("storm_id")
    )


def storms_by_name(tracks: DataFrame, name: str) -> DataFrame:
    """Ids of storms with this name; the lookup text may be in any case."""
    return (
        tracks.filter(F.col("name") == name.upper())
        .select("storm_id")
        .distinct()
        .orderBy("storm_id")
    )


def storm_catalog(tracks: DataFrame, order: str | list[str] = "timestamp") -> DataFrame:
    """Storm id and the name on its first row; ``["file", "line_no"]`` makes that the first row in file order."""
    first = F.struct(*order) if isinstance(order, list) else F.col(order)
    return tracks.groupBy("storm_id").agg(F.min_by("name", first).alias("name"))


def recent_storms(catalog: DataFrame, since_year: int, count: int = 10) -> DataFrame:
    """The ``count`` highest ids among storms whose id names ``since_year`` or later."""
    year = F.expr("try_cast(substring(storm_id, 5, 4) AS INT)")
    newest = (
        catalog.withColumn("year", year)
        .filter(F.col("year") >= since_year)
        .orderBy(F.col("storm_id").desc())
        .limit(count)
    )
    return newest.orderBy("storm_id")


def storm_list_tracks(tracks: DataFrame, storm_ids: DataFrame) -> DataFrame:
    """Fixes of the storms in a list (one ``storm_id`` column)."""
    return tracks.join(storm_ids.select("storm_id"), "storm_id", "left_semi")


def season_split(tracks: DataFrame, seasons: dict[str, list[int]] | None = None) -> DataFrame:
    """Label every fix with the split its year belongs to."""
    label = None
    for name, years in (seasons or SEASON_YEARS).items():
        hit = F.year("timestamp").isin(years)
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return tracks.withColumn("split", label.otherwise(F.lit("unassigned")))


def storm_list_split(
    tracks: DataFrame,
    train: list[str],
    validation: list[str],
    test: list[str] | None = None,
    test_years: list[int] | None = None,
) -> DataFrame:
    """One row per storm and split.

    An empty test list means every storm of the test years that is in neither of
    the other lists.
    """
    years = test_years or SEASON_YEARS["test"]
    in_test = F.col("storm_id").isin(test) if test else F.year("timestamp").isin(years)
    split = (
        F.when(F.col("storm_id").isin(train), "train")
        .when(F.col("storm_id").isin(validation), "validation")
        .when(in_test, "test")
    )
    return (
        tracks.select("storm_id", split.alias("split"))
        .filter(F.col("split").isNotNull())
        .distinct()
    )


def history_truth_split(
    tracks: DataFrame, history: int, forecast: int, order: str = "timestamp", numbered: str | None = None
) -> DataFrame:
    """First ``history`` fixes of each storm and the ``forecast`` fixes after them.

    The row-number bound is pushed below the exchange, so a task never ships more than
    ``history + forecast`` rows of a storm, as long as that sum is at most
    ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000 by default).  ``numbered``
    names a column that numbers each storm's fixes from 1 without gaps; then the table
    is only filtered.  No column is taken for such a number by its name.
    """
    if numbered:
        number = F.col(numbered)
    else:
        number = F.row_number().over(Window.partitionBy("storm_id").orderBy(order))
    # bounded on the bare number: behind a cast the bound would not be pushed down
    first = (
        tracks.withColumn("_tempestry_number", number)
        .filter(F.col("_tempestry_number") <= history + forecast)
        .withColumn("step", F.col("_tempestry_number").cast("int"))
        .drop("_tempestry_number")
    )
    role = F.when(F.col("step") <= history, "history").otherwise("truth")
    return first.withColumn("role", role)


def last_fix(tracks: DataFrame) -> DataFrame:
    """Latest fix of each storm."""
    rest = [c for c in tracks.columns if c != "storm_id"]
    latest = tracks.groupBy("storm_id").agg(
        F.max_by(F.struct(*rest), F.col("timestamp")).alias("fix")
    )
    return latest.select("storm_id", "fix.*")


def archive_counts(tracks: DataFrame) -> DataFrame:
    return tracks.agg(
        F.count(F.lit(1)).alias("n_records"), F.countDistinct("storm_id").alias("n_storms")
    )


def peak_intensity(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("storm_id").agg(F.max("max_wind").alias("max_intensity"))


def storm_bbox(tracks: DataFrame, pad: float = 0.0) -> DataFrame:
    """Bounding box (padded) and time span of each storm."""
    return tracks.groupBy("storm_id").agg(
        (F.min("latitude") - pad).alias("lat_min"),
        (F.max("latitude") + pad).alias("lat_max"),
        (F.min("longitude") - pad).alias("lon_min"),
        (F.max("longitude") + pad).alias("lon_max"),
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"),
    )


def storm_summary(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("storm_id").agg(
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"),
        F.max("max_wind").alias("max_intensity"),
        F.min("min_pressure").alias("min_pressure"),
        F.count(F.lit(1)).alias("num_records"),
    )


def training_catalog(
    tracks: DataFrame, years: list[int], min_intensity: float = 64, order: str = "timestamp"
) -> DataFrame:
    """Storms of the years whose whole-track peak wind reaches the threshold.

    Aggregates cover the whole track, so a storm active in two requested years
    gives two rows.  One scan and one exchange: years collapse to a small set per
    storm instead of a join of two aggregates.
    """
    per_storm = tracks.groupBy("storm_id").agg(
        F.min_by("name", order).alias("name"),
        F.collect_set(F.year("timestamp")).alias("_tempestry_years"),
        F.max("max_wind").alias("max_intensity"),
        F.min("min_pressure").alias("min_pressure"),
        F.count(F.lit(1)).alias("num_records"),
    )
    wanted = F.array(*[F.lit(y) for y in years])
    return (
        per_storm.filter(F.col("max_intensity") >= min_intensity)
        .withColumn("year", F.explode(F.array_intersect("_tempestry_years", wanted)))
        .select("storm_id", "name", "year", "max_intensity", "min_pressure", "num_records")
    )


def storms_per_year(tracks: DataFrame, years: list[int] | None = None) -> DataFrame:
    """Number of storms active in each year; listed years without storms count 0."""
    counts = (
        tracks.groupBy(F.year("timestamp").alias("year"), "storm_id")
        .agg(F.lit(1).alias("_tempestry_one"))
        .groupBy("year")
        .agg(F.count(F.lit(1)).alias("n_storms"))
    )
    if years is None:
        return counts
    listed = tracks.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(y) for y in years])).alias("year")
    )
    return listed.join(counts, "year", "left").fillna(0, ["n_storms"])


def year_activity(per_year: DataFrame) -> DataFrame:
    """Average storms per year and the busiest and quietest year (ties: earliest)."""
    earliest = -F.col("year")
    return per_year.agg(
        F.avg("n_storms").alias("average_storms"),
        F.max_by("year", F.struct("n_storms", earliest)).alias("most_active_year"),
        F.max("n_storms").alias("most_active_storms"),
        F.min_by("year", F.struct("n_storms", "year")).alias("least_active_year"),
        F.min("n_storms").alias("least_active_storms"),
    )


def add_category(tracks: DataFrame) -> DataFrame:
    return tracks.withColumn("category", storm_category(F.col("max_wind")))


def one_hot(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """One 0/1 column per level; a missing value is 0 in all of them."""
    flags = {
        f"{column}_{level}": F.coalesce((F.col(column) == level).cast("int"), F.lit(0))
        for level in levels
    }
    return df.withColumns(flags)


def archive_union(primary: DataFrame, secondary: DataFrame, drop_duplicates: bool = True):
    """Two archives in one schema; of a fix in both, the primary's row is kept."""
    if drop_duplicates:
        known = primary.select("storm_id", "timestamp")
        secondary = secondary.join(known, ["storm_id", "timestamp"], "left_anti")
    # row numbers of either archive do not number the merged one
    return primary.unionByName(secondary, allowMissingColumns=True).drop(POINT)
