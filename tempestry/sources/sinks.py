"""Writers, and the guard against incomplete scores."""

import itertools
import os
import re
import uuid

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tempestry.functions.clock import MICROS_PER_HOUR, micros
from tempestry.functions.geo import wrap_longitude

STATS_SCHEMA = "variable string, mean double, std double"
#: Pages of Parquet files carry checksums, compared on reading.
VERIFIED = {"parquet.page.verify-checksum.enabled": "true"}
#: Name of the directory of missing values.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
#: Characters that names of directories write as %XX, as Spark does.
ESCAPED = re.compile(r"""["#%'*/:=?\\\x7f{\[\]^\x00-\x1f]""")
#: Columns that Arrow writes as Spark reads them.
ARROW_TYPES = ("string", "double", "float", "bigint", "int", "smallint", "tinyint", "boolean", "date", "timestamp", "timestamp_ntz", "binary")
#: Rows of a group in files of one storm.
GROUP_ROWS = 200_000


def write_scores(scores: DataFrame, path: str) -> None:
    """JSON for a path ending in ``.json``, CSV with a header otherwise."""
    if path.endswith(".json"):
        scores.write.mode("overwrite").json(path)
    else:
        scores.write.mode("overwrite").option("header", True).csv(path)


def write_storm_dataset(
    tracks: DataFrame,
    path: str,
    grid: DataFrame | None = None,
    csv: bool = False,
    per_storm: bool = False,
) -> None:
    """Tracks and storm cubes under ``path``.

    By default the tables are range-partitioned by storm and time, so files cover
    few storms, a lookup skips the others by file statistics, and a very long
    storm is spread over several files.  ``per_storm`` makes one directory per
    storm instead; ``read_by_storm`` reads many of them.
    """
    _write_by_storm(tracks, f"{path}/track", "timestamp", csv, per_storm)
    if grid is not None:
        _write_by_storm(grid, f"{path}/grid", "time", False, per_storm)


def _write_by_storm(df, path, time, csv, per_storm):
    order = [c for c in ("storm_id", time, "latitude", "longitude") if c in df.columns]
    folder = local_folder(df.sparkSession, path) if per_storm and not csv and _plain(df) else None
    if folder:
        _write_storm_folders(df, order, path, folder)
        return
    laid_out = df.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = laid_out.write.mode("overwrite")
    if per_storm:
        writer = writer.partitionBy("storm_id")
    if csv:
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def local_folder(spark: SparkSession, path: str) -> str | None:
    """The folder of a path in the local file system, as Hadoop understands it; None for paths in other stores."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return place.makeQualified(store.getUri(), store.getWorkingDirectory()).toUri().getPath() if store.getUri().getScheme() == "file" else None


def _plain(df):
    kinds = dict(df.dtypes)
    return kinds.get("storm_id") == "string" and len(kinds) > 1 and all(k in ARROW_TYPES or k.startswith("decimal") for k in kinds.values())


def _write_storm_folders(df, order, path, folder):
    """One directory per storm in a local folder.

    Hadoop starts five processes for each small file and its directory there, to set permissions; here tasks write the files with
    Arrow.  A file has the same name in each attempt of its task and appears whole.  ``_SUCCESS`` comes last.
    """
    # what was there before goes; an empty id has the directory of missing ones, as in Spark
    begun = df.limit(0).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    begun.partitionBy("storm_id").parquet(path)
    known = df.withColumn("storm_id", F.nullif("storm_id", F.lit("")))
    laid_out = known.repartitionByRange(*order).sortWithinPartitions(*order)
    laid_out.mapInArrow(_storm_writer(folder, uuid.uuid4().hex), "files bigint").agg(F.sum("files")).collect()
    os.makedirs(folder, exist_ok=True)
    open(f"{folder}/_SUCCESS", "w").close()


def _storm_writer(folder, run):
    def save(storm, parts, name):
        """Write the parts of a storm's table to its file under a hidden name."""
        text = NO_VALUE if storm is None else ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", storm)
        os.makedirs(at := f"{folder}/storm_id={text}", exist_ok=True)
        hidden = f"{at}/.{name}-{uuid.uuid4().hex}"
        first = next(parts)
        with pq.ParquetWriter(hidden, first.schema, write_page_checksum=True) as out:
            for part in itertools.chain([first], parts):
                out.write_table(part, row_group_size=GROUP_ROWS)
        os.replace(hidden, f"{at}/{name}")

    def runs(batches):
        """(storm, rows) of runs of one storm in each batch."""
        for batch in batches:
            rows, start = batch.drop_columns(["storm_id"]), 0
            storms = pc.run_end_encode(batch.column("storm_id"))
            for storm, end in zip(storms.values.to_pylist(), storms.run_ends.to_pylist()):
                yield storm, rows.slice(start, end - start)
                start = end

    def grouped(rows):
        """Tables of GROUP_ROWS rows or a little more, the last one excepted."""
        held, n = [], 0
        for part in rows:
            held.append(part)
            n += part.num_rows
            if n >= GROUP_ROWS:
                yield pa.Table.from_batches(held)
                held, n = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def write(batches):
        name, files = f"part-{TaskContext.get().partitionId():05d}-{run}.snappy.parquet", 0
        for storm, rows in itertools.groupby(runs(batches), key=lambda pair: pair[0]):
            save(storm, grouped(part for _, part in rows), name)
            files += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    return write


def read_by_storm(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The Parquet table of one directory per storm at ``path``, with ``schema``, ``storm_id`` coming last.

    Ids are taken from the directories' names row by row.  Spark's own discovery takes time that grows with the square of the number
    of directories, and reads ids such as 0042 as numbers.
    """
    inside = StructType([f for f in schema.fields if f.name != "storm_id"])
    rows = spark.read.schema(inside).options(recursiveFileLookup="true", **VERIFIED).parquet(path)

    def decoded(text):
        # a plus stands for itself here
        return F.when(text.contains("%"), F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))).otherwise(text)

    folder = F.substring_index(F.substring_index("_metadata.file_path", "/", -2), "/", 1)
    # the path is that of a URL, and the directory's name is escaped
    value = decoded(decoded(F.substring_index(folder, "=", -1)))
    known = F.when(value != NO_VALUE, value).cast(schema["storm_id"].dataType)
    return rows.select("*", known.alias("storm_id"))


def write_grid(grid: DataFrame, path: str) -> None:
    """Wide grid in directories by year, rows in order of time and place.

    A time range prunes directories, then files and row groups by statistics.
    """
    order = [c for c in ("time", "latitude", "longitude") if c in grid.columns]
    laid_out = grid.withColumn("year", F.year("time")).repartitionByRange(*order)
    laid_out.sortWithinPartitions(*order).write.mode("overwrite").partitionBy("year").parquet(path)


# -- layout by place and time ----------------------------------------------------------------------

#: Steps of each axis on the curve, as a power of two.
CURVE_BITS = 10


def curve_place(hours: float) -> Column:
    """Place of a cell on a curve through (time, latitude, longitude) that keeps near cells near.

    The bits of the three axes take turns.  One step is ``hours`` long, about 0.18 degrees of latitude or 0.35 of longitude;
    times count modulo 2 ** CURVE_BITS steps, whole turns coming first.
    """
    steps = 1 << CURVE_BITS
    ticks = F.floor(micros(F.col("time")) / F.lit(hours * MICROS_PER_HOUR)).cast("long")
    north = F.floor((F.col("latitude").cast("double") + 90) / 180 * (steps - 1)).cast("long")
    east = F.floor((wrap_longitude(F.col("longitude")).cast("double") + 180) / 360 * (steps - 1)).cast("long")
    place = F.floor(ticks / steps).cast("long") * (1 << 3 * CURVE_BITS)
    for bit in range(CURVE_BITS):
        for turn, axis in enumerate((F.pmod(ticks, F.lit(steps)), north, east)):
            place = place + F.shiftleft(F.shiftright(axis, bit).bitwiseAND(F.lit(1).cast("long")), 3 * bit + 2 - turn)
    return place


def write_pruned_grid(grid: DataFrame, path: str, hours: float = 6.0, files: int | None = None) -> None:
    """Wide grid along a space-filling curve, so that a file covers a small box and a short time; with an index of the files.

    ``path/cells`` holds the grid, ``path/index`` one row per file with its bounds.
    """
    laid_out = grid.withColumn("_curve", curve_place(hours))
    laid_out = laid_out.repartitionByRange(files, "_curve") if files else laid_out.repartitionByRange("_curve")
    laid_out.sortWithinPartitions("_curve").drop("_curve").write.mode("overwrite").parquet(f"{path}/cells")
    cells = grid.sparkSession.read.schema(grid.schema).parquet(f"{path}/cells")
    bounds = [f(c).alias(f"{f.__name__}_{c}") for c in ("time", "latitude", "longitude") for f in (F.min, F.max)]
    index = cells.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n_cells"), *bounds)
    index.write.mode("overwrite").parquet(f"{path}/index")


def box_files(spark: SparkSession, path: str, south: float, north: float, west: float, east: float, start, end) -> DataFrame:
    """The index rows of the files that can hold a cell of the box, ends included; ``west`` beyond ``east`` crosses the dateline."""
    index = spark.read.parquet(f"{path}/index")
    inside = (F.col("max_latitude") >= south) & (F.col("min_latitude") <= north)
    inside = inside & (F.col("max_time") >= F.lit(start).cast("timestamp_ntz")) & (F.col("min_time") <= F.lit(end).cast("timestamp_ntz"))
    beyond_west, beyond_east = F.col("max_longitude") >= west, F.col("min_longitude") <= east
    return index.where(inside & ((beyond_west & beyond_east) if west <= east else (beyond_west | beyond_east)))


def read_box(spark: SparkSession, path: str, south: float, north: float, west: float, east: float, start, end) -> DataFrame:
    """Cells of a box and time range, ends included, from the files that can hold some.

    The names of those files come to the driver; all others are not opened.
    """
    files = [r["file"] for r in box_files(spark, path, south, north, west, east, start, end).select("file").collect()]
    schema = spark.read.parquet(f"{path}/cells").schema
    cells = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    lon = F.col("longitude")
    across = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return cells.where(
        F.col("latitude").between(south, north) & across
        & F.col("time").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    )


# -- plain grids -----------------------------------------------------------------------------------


def read_grid(spark: SparkSession, path: str, years: list[int] | None = None) -> DataFrame:
    grid = spark.read.parquet(path)
    if years is not None:
        grid = grid.filter(F.col("year").isin(years))
    return grid.drop("year")


def save_stats(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").json(path)


def load_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATS_SCHEMA).json(path)


def missing_scores(scores: DataFrame) -> DataFrame:
    """(metric, n_missing): how many scores of each metric are missing or NaN."""
    kinds = dict(scores.dtypes)
    metrics = [c for c in scores.columns if c not in ("storm_id", "forecast")]
    if not metrics:
        raise ValueError("the table has no metric")

    def gaps(m):
        gone = F.col(m).isNull() | F.isnan(m) if kinds[m] in ("float", "double") else F.col(m).isNull()
        return F.struct(F.lit(m).alias("metric"), F.count(F.when(gone, 1)).alias("n_missing")).alias(m)

    counted = scores.agg(*[gaps(m) for m in metrics])
    return counted.select(F.inline(F.array(*metrics)))


def require_complete(scores: DataFrame) -> None:
    """Raise if any score is missing; a row per metric comes back."""
    bad = {r["metric"]: r["n_missing"] for r in missing_scores(scores).collect() if r["n_missing"]}
    if bad:
        raise ValueError(f"missing scores: {bad}")
