"""Writers: tables by layout, written once unless asked otherwise."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.workspace import exists, file_system


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was completely written at a path."""
    return exists(spark, f"{path}/_SUCCESS")


@contextmanager
def locked(spark: SparkSession, path: str) -> Iterator[None]:
    """Hold ``<path>.lock``, made in one step by one run only."""
    lock = f"{path.rstrip('/')}.lock"
    fs, target = file_system(spark, lock)
    if not fs.createNewFile(target):
        raise FileExistsError(f"{path} is being written; if no run does so, delete {lock}")
    try:
        yield
    finally:
        fs.delete(target, False)


def write_table(df: DataFrame, path: str, overwrite: bool = False, skip_if_exists: bool = False, partition_by: Sequence[str] = (), compression: str = "zstd") -> bool:
    """Write a table as Parquet; True if it was written.

    A path that exists is an error, unless ``overwrite``, or ``skip_if_exists`` and the table
    there is complete. So is a path that another run is writing: a file ``<path>.lock`` says so,
    which a run that was killed leaves behind. TypeError for anything but a DataFrame.
    """
    if not isinstance(df, DataFrame):
        raise TypeError(f"can't write a {type(df).__name__}")
    if skip_if_exists and not overwrite and finished(df.sparkSession, path):
        return False
    with locked(df.sparkSession, path):
        df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", compression).partitionBy(*partition_by).parquet(path)
    return True


def write_features(features: DataFrame, path: str, overwrite: bool = False, skip_if_exists: bool = False) -> bool:
    """The long feature table by split, window and aggregation; zeros, NaN and nulls aren't stored.

    The rows of one (split, window, agg) are spread over files by subject, so a hot block has many writers.
    """
    cells = features.where("value is not null and value <> 0 and not isnan(value)").withColumn("window", F.coalesce("window", F.lit("none")))
    cells = cells.withColumn("agg", F.regexp_replace("agg", "/", "__"))
    return write_table(cells, path, overwrite, skip_if_exists, [c for c in ("split", "window", "agg") if c in cells.columns])


def read_features(spark: SparkSession, path: str, windows: Sequence[str] | None = None, aggs: Sequence[str] | None = None) -> DataFrame:
    """The stored feature table; windows and aggregations prune the folders that are read."""
    # Folder names such as 7d would be read as numbers: they are strings, whatever they look like.
    found = spark.read.parquet(path).schema
    named = [T.StructField(f.name, T.StringType()) if f.name in ("split", "window", "agg") else f for f in found]
    df = spark.read.schema(T.StructType(named)).parquet(path)
    if windows is not None:
        df = df.where(F.col("window").isin([*windows, "none"]))
    if aggs is not None:
        df = df.where(F.col("agg").isin([a.replace("/", "__") for a in aggs]))
    return df.withColumn("agg", F.regexp_replace("agg", "__", "/"))
