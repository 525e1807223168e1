"""Tables written once to the folder that driver and executors share, and read back."""

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where it names none, as in tests, a folder in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return folder.rstrip("/")


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None, folder: str | None = None) -> DataFrame:
    """The rows of df, written as Parquet in one pass; what follows reads the files, which outlive any executor."""
    path = f"{folder or shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*(partition_by or [])).parquet(path)
    # columns that name directories come last when they are read back
    fields = [f for f in df.schema.fields if f.name not in (partition_by or [])]
    fields += [f for f in df.schema.fields if f.name in (partition_by or [])]
    return df.sparkSession.read.schema(type(df.schema)(fields)).parquet(path)
