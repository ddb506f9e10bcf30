"""How often each code occurs: as a timeless fact or an event, with or without a value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def code_frequencies(observations: DataFrame) -> DataFrame:
    """Feature names and counts: (code, count), features that never occur left out.

    Per code four counts in one pass: rows without time (``/static/present``), of these with a
    value (``/static/first``), rows with time (``/code``) and of these with a value (``/value``).
    Rows without subject or code are left out.
    """
    static, valued = F.col("time").isNull(), F.col("numeric_value").isNotNull()
    counted = (
        observations.where("subject_id is not null and code is not null")
        .groupBy("code")
        .agg(
            F.count_if(static).alias("static/present"),
            F.count_if(static & valued).alias("static/first"),
            F.count_if(~static).alias("code/"),
            F.count_if(~static & valued).alias("value"),
        )
    )
    pairs = F.stack(
        F.lit(4), F.lit("static/present"), F.col("`static/present`"), F.lit("static/first"), F.col("`static/first`"), F.lit("code"), F.col("`code/`"), F.lit("value"), F.col("value")
    ).alias("kind", "count")
    return counted.select("code", pairs).where("count > 0").select(F.concat_ws("/", "code", "kind").alias("code"), "count")


def merge_frequencies(*tables: DataFrame) -> DataFrame:
    """Frequency tables of parts of the data as that of the whole."""
    every = reduce(DataFrame.unionByName, tables)
    return every.groupBy("code").agg(F.sum("count").cast("long").alias("count"))


def as_dict(frequencies: DataFrame) -> dict[str, int]:
    """A frequency table as a dict, for use on the driver; ValueError unless its columns are code and count."""
    if frequencies.columns != ["code", "count"]:
        raise ValueError("a frequency table has the columns code and count")
    return {r["code"]: r["count"] for r in frequencies.collect()}


def from_dict(spark, counts: dict[str, int]) -> DataFrame:
    """A dict as a frequency table."""
    return spark.createDataFrame(list(counts.items()), "code string, count long")
