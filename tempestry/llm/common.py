"""Helpers shared by the corpus operators: Arrow functions over text columns and tables in the shared folder."""

import json
import uuid
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: So many texts of an Arrow batch are Python objects at a time.
AT_ONCE = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see, from the session's spark.checkpoint.dir.

    Only where the session names none (single-machine tests) a folder beside the warehouse is taken.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once as Parquet in the shared folder and read back.

    What follows reads files that outlive any executor, and the lineage ends here.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """df with `place` (from 0, by `order`) of each row among the rows of its keys, their number `total`, and `first`.

    `first` is the same number for all rows of equal keys and rises with the keys. Rows are range-partitioned on keys
    and order, sorted and written to the shared folder once; the rest are counts per partition and key. So rows of
    one key spread over many tasks, provided that `order` ends in a column that tells rows apart. Ranges are found in a
    pass of their own: df should be cheap to read. Nulls come first; null keys are a key like any other.
    """
    by = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    ranges = df.repartitionByRange(shuffle_partitions(df.sparkSession), *by).sortWithinPartitions(*by)
    # Numbers of rows begin anew in each partition, whose own number is above the lowest 33 bits.
    placed = stored(ranges.withColumn("_at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy(*keys, "_part").agg(F.min("_at").alias("_begin"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
        F.col("_part").alias("_own"),
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_begin")).alias("_shift"),
        F.sum("_rows").over(whole).alias("total"),
        F.min("_begin").over(whole).alias("first"),
    )
    same = F.col("_part") == F.col("_own")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    found = placed.join(parts, same)
    return found.select(*df.columns, (F.col("_at") + F.col("_shift")).alias("place"), "total", "first")


def local_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from the driver's own rows, as an expression: no Python runs on the executors."""
    listed = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(listed))


def text_function(make, returns: str, name: str):
    """A column function over one text column that runs on Arrow batches.

    make() is called once per task and gives a function from a list of texts as UTF-8 bytes (None for
    null) to an Arrow array of the type `returns`. The function counts as nondeterministic so that the
    optimizer never evaluates it twice, once for a filter and once for its output.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = make()
        for batch in batches:
            texts = batch.cast(pa.binary())
            # a few rows at a time are Python objects beside the Arrow batch
            parts = [work(texts.slice(i, AT_ONCE).to_pylist()) for i in range(0, max(len(texts), 1), AT_ONCE)]
            yield parts[0] if len(parts) == 1 else pa.concat_arrays(parts)

    run.__name__ = name
    return F.arrow_udf(run, returns).asNondeterministic()


def crc_bucket(key: Column, modulus: int) -> Column:
    """crc32 of the key's text, modulo `modulus`; a null key counts as the empty string."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
