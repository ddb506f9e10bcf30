"""As-of joins: for each row the nearest event of its subject on one side of its time, and counts up to it.

All work in two levels, so that a subject with a third of all rows is sorted in as many parts as
it has buckets of time: within a (subject, bucket) rows and events are sorted together and the
last event is carried along; what lies in other buckets comes from one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _points(events: DataFrame, event_time: str) -> DataFrame:
    return events.select("subject_id", F.col(event_time).alias("_t")).where("subject_id is not null and _t is not null")


def _nearest(left: DataFrame, events: DataFrame, time: str, event_time: str, bucket: str, forward: bool, strict: bool) -> DataFrame:
    rows = left.withColumnRenamed(time, "_t").withColumn("_side", F.lit(1)).withColumn("_e", F.lit(None).cast("timestamp_ntz"))
    # At equal times an event stands before the row if it counts, after it if it doesn't.
    points = _points(events, event_time).distinct().withColumn("_side", F.lit(2 if strict else 0)).withColumn("_e", F.col("_t"))
    both = rows.unionByName(points, allowMissingColumns=True).withColumn("_b", F.date_trunc(bucket, "_t"))
    turn = F.desc if forward else F.asc
    within = Window.partitionBy("subject_id", "_b").orderBy(turn("_t"), "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("_near", F.last("_e", True).over(within)).where("_side = 1")
    edge = F.min("_e") if forward else F.max("_e")
    per_bucket = both.where("subject_id is not null").groupBy("subject_id", "_b").agg(edge.alias("_last"))
    others = Window.partitionBy("subject_id").orderBy(turn("_b")).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select("subject_id", "_b", F.last("_last", True).over(others).alias("_far")).where("_far is not null")
    found = F.when(F.col("subject_id").isNotNull() & F.col("_t").isNotNull(), F.coalesce("_near", "_far"))
    kept = [c for c in left.columns if c not in ("subject_id", time)]
    return near.join(carried, ["subject_id", "_b"], "left").select("subject_id", F.col("_t").alias(time), *kept, found.alias("event_time"))


def latest_before(left: DataFrame, events: DataFrame, time: str = "time", event_time: str = "time", bucket: str = "year", strict: bool = False) -> DataFrame:
    """``left`` with ``event_time``: the subject's latest event at or before ``time``, null if none.

    ``strict``: before it only. ``left`` has subject_id and ``time``, ``events`` subject_id and
    ``event_time``. Rows of ``left`` with null subject or time find nothing; its other columns stay.
    """
    return _nearest(left, events, time, event_time, bucket, False, strict)


def next_after(left: DataFrame, events: DataFrame, time: str = "time", event_time: str = "time", bucket: str = "year", strict: bool = True) -> DataFrame:
    """``left`` with ``event_time``: the subject's first event after ``time`` (or at it, unless ``strict``), null if none."""
    return _nearest(left, events, time, event_time, bucket, True, strict)


def count_until(left: DataFrame, events: DataFrame, time: str, name: str, event_time: str = "time", bucket: str = "year", strict: bool = False) -> DataFrame:
    """``left`` with ``name``: how many of the subject's events lie at or before ``time`` (before it only, if ``strict``).

    A null time counts nothing.
    """
    rows = left.withColumnRenamed(time, "_t").withColumn("_side", F.lit(1)).withColumn("_n", F.lit(0).cast("long"))
    points = _points(events, event_time).groupBy("subject_id", "_t").agg(F.count("*").alias("_n")).withColumn("_side", F.lit(2 if strict else 0))
    both = rows.unionByName(points, allowMissingColumns=True).withColumn("_b", F.date_trunc(bucket, "_t"))
    within = Window.partitionBy("subject_id", "_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("_near", F.sum("_n").over(within)).where("_side = 1").drop("_n")
    before = Window.partitionBy("subject_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy("subject_id", "_b").agg(F.sum("_n").alias("_s")).select("subject_id", "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_far"))
    kept = [c for c in left.columns if c not in ("subject_id", time)]
    count = F.when(F.col("_t").isNotNull(), F.col("_near") + F.coalesce("_far", F.lit(0))).otherwise(0)
    return near.join(carried, ["subject_id", "_b"], "left").select("subject_id", F.col("_t").alias(time), *kept, count.cast("long").alias(name))
