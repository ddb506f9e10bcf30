"""Timeless facts of subjects: their mean value, or that they are there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def static_first(observations: DataFrame) -> DataFrame:
    """(subject_id, code, value): the mean of the values of rows without time. Facts without a value have no row."""
    facts = observations.where("time is null and subject_id is not null and code is not null and numeric_value is not null")
    return facts.groupBy("subject_id", "code").agg(F.avg("numeric_value").alias("value"))


def static_present(observations: DataFrame) -> DataFrame:
    """(subject_id, code, present): true for every fact a subject has, with a value or not."""
    facts = observations.where("time is null and subject_id is not null and code is not null")
    return facts.select("subject_id", "code").distinct().withColumn("present", F.lit(True))


def static_wide(observations: DataFrame, first: Sequence[str] = (), present: Sequence[str] = ()) -> DataFrame:
    """One row per subject with facts, a column ``<code>/static/first`` or ``<code>/static/present`` per code listed.

    The columns are those listed, in this order, whatever the data hold; a missing value is null,
    an absent fact false. For a short list of codes; a long one stays in rows.
    """
    facts = observations.where("time is null and subject_id is not null and code is not null")
    means = [F.avg(F.when(F.col("code") == c, F.col("numeric_value"))).alias(f"{c}/static/first") for c in first]
    there = [F.coalesce(F.bool_or(F.col("code") == c), F.lit(False)).alias(f"{c}/static/present") for c in present]
    if not means and not there:
        raise ValueError("no static feature to summarize")
    return facts.groupBy("subject_id").agg(*means, *there)


def replicate_static(index: DataFrame, static: DataFrame) -> DataFrame:
    """Each index row with its subject's facts; subjects without facts have nulls."""
    return index.join(static, "subject_id", "left")
