"""Readers: tables of a data folder, observation shards, labels, trial logs, and adapters of other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.values import clean_code, finite
from tallyloom.schema import OBSERVATIONS, conform
from tallyloom.workspace import file_system


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder, by name."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def list_shards(spark: SparkSession, root: str, ext: str = "parquet") -> dict[str, str]:
    """The shards below ``root`` in any file system that Spark reads: ``train/0`` and the like, sorted, with the files' URIs.

    A shard is named by the folders between the root and its file, and the file's name up to its
    first dot. Two files of one name are an error; a folder that isn't there has no shards.
    """
    fs, path = file_system(spark, root)
    if not fs.exists(path):
        return {}
    top = fs.getFileStatus(path).getPath().toUri()
    found: dict[str, str] = {}
    files = fs.listFiles(path, True)
    while files.hasNext():
        uri = files.next().getPath().toUri()
        folders, _, file = ("/" + top.relativize(uri).getPath()).rpartition("/")
        if not file.endswith("." + ext.lstrip(".")):
            continue
        name = f"{folders}/{file.partition('.')[0]}".lstrip("/")
        if name in found:
            raise ValueError(f"two files of shard {name}")
        found[name] = uri.toString()
    return dict(sorted(found.items()))


def with_shard(df: DataFrame) -> DataFrame:
    """``split`` and ``shard`` from the path ``<split>/<shard>.parquet`` of the file that each row was read from."""
    path = F.regexp_replace(F.col("_metadata.file_path"), r"\?.*$", "")
    return df.select("*", F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("split"), F.regexp_extract(path, r"([^/]+?)\.[^/]*$", 1).alias("shard"))


def read_observations(spark: SparkSession, root: str) -> DataFrame:
    """All observation shards below a folder, with their split and shard; a table without values gets nulls."""
    raw = with_shard(spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(root))
    if "numeric_value" not in raw.columns:
        raw = raw.withColumn("numeric_value", F.lit(None).cast("double"))
    return conform(raw, T.StructType([*OBSERVATIONS, T.StructField("split", T.StringType()), T.StructField("shard", T.StringType())]))


def read_labels(spark: SparkSession, root: str, label_column: str = "boolean_value", order: str | None = None) -> DataFrame:
    """All label files below a folder: subject_id, time, label, and what else they hold; ``order``: a column for the place of each row, by file and row in it."""
    raw = spark.read.option("recursiveFileLookup", True).parquet(root)
    if order is not None:
        raw = raw.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias(order))
    if "prediction_time" not in raw.columns or label_column not in raw.columns:
        raise ValueError(f"labels need prediction_time and {label_column}")
    return raw.withColumnRenamed("prediction_time", "time").withColumnRenamed(label_column, "label")


# -- adapters to the observation table ---------------------------------------------------------


def observations_of_measurements(spark: SparkSession, folder: str) -> DataFrame:
    """``measurements`` as observations: codes cleaned, NaN null, all rows."""
    m = table(spark, folder, "measurements")
    return m.select("subject_id", F.col("time").cast("timestamp_ntz").alias("time"), clean_code(F.col("code")).alias("code"), finite(F.col("numeric_value")).alias("numeric_value"))


def observations_of_events(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as observations; views and clicks are codes without a value."""
    e = table(spark, folder, "events")
    value = F.when(~F.col("event_type").isin("view", "click"), F.col("value"))
    return e.select(F.col("user_id").alias("subject_id"), F.col("ts").cast("timestamp_ntz").alias("time"), F.col("event_type").alias("code"), value.alias("numeric_value"))


def statics_of_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as timeless facts: their segment, without a value, and their balance."""
    c = table(spark, folder, "customer")
    null = F.lit(None)
    segment = c.select(F.col("c_custkey").alias("subject_id"), null.cast("timestamp_ntz").alias("time"), F.concat(F.lit("SEGMENT//"), "c_mktsegment").alias("code"), null.cast("double").alias("numeric_value"))
    return segment.unionByName(c.select(F.col("c_custkey").alias("subject_id"), null.cast("timestamp_ntz").alias("time"), F.lit("ACCTBAL").alias("code"), F.col("c_acctbal").alias("numeric_value")))


def observations_of_shipments(spark: SparkSession, folder: str) -> DataFrame:
    """Line items of orders as observations of customers: many rows share a time, and values may be 0."""
    orders, items = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    joined = items.join(orders, items["l_orderkey"] == orders["o_orderkey"])
    code = F.concat_ws("//", F.lit("SHIP"), "l_returnflag", "l_linestatus")
    return joined.select(F.col("o_custkey").alias("subject_id"), F.col("l_shipdate").cast("timestamp_ntz").alias("time"), code.alias("code"), F.col("l_discount").alias("numeric_value"))


def labels_of_events(spark: SparkSession, folder: str) -> DataFrame:
    """A label per user and day of activity, at midnight: whether they purchase within seven days."""
    e = table(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type")
    days = e.select("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).distinct()
    # Purchase days are few per user; each day looks at the purchases of its own and the next seven days.
    bought = e.where("event_type = 'purchase'").select("user_id", "ts", F.explode(F.expr("sequence(-7, 0)")).alias("_d"))
    bought = bought.select("user_id", "ts", (F.to_date("ts") + F.col("_d")).alias("_day")).withColumn("_at", F.col("_day").cast("timestamp_ntz"))
    hit = bought.where((F.col("ts") > F.col("_at")) & (F.col("ts") <= F.col("_at") + F.expr("interval 7 days"))).select("user_id", F.col("_at").alias("day")).distinct().withColumn("label", F.lit(1))
    return days.join(hit, ["user_id", "day"], "left").select(F.col("user_id").alias("subject_id"), F.col("day").alias("time"), F.coalesce("label", F.lit(0)).alias("label"))


def split_of_subject(subject):
    """A fixed split by subject, seven in ten for training, two for tuning, one held out."""
    part = F.pmod(subject, F.lit(10))
    return F.when(part < 7, "train").when(part < 9, "tuning").otherwise("held_out")
