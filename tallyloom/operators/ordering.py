"""Row numbers and running totals over a whole table, without bringing it into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.workspace import staged


def _in_ranges(df: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """The rows range-partitioned by ``order``, each with its range ``_p``, written once so that ranges are settled."""
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_p", F.spark_partition_id())
    return staged(ranged, label)


def running_total(df: DataFrame, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over all rows up to and including this one, in order of ``order``.

    Each range of rows is summed on its own; the sums of the ranges before it, as many rows as
    there are partitions, are broadcast. Rows that tie in ``order`` share a range and are summed
    one after the other in no fixed order.
    """
    ranged = _in_ranges(df.withColumn("_v", value), order, "running")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_p").agg(F.sum("_v").alias("_s")).select("_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    within = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.withColumn(name, F.sum("_v").over(within)).join(F.broadcast(offsets), "_p").withColumn(name, F.col(name) + F.col("_o")).drop("_p", "_o", "_v")


def number_rows(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``name``: the row's number from 0 in order of ``order``."""
    return running_total(df, order, F.lit(1).cast("long"), name).withColumn(name, F.col(name) - 1)


def assert_sorted(df: DataFrame, order: Sequence[str]) -> None:
    """ValueError unless ``order`` has no null and never falls from one row of ``df`` to the next, in and between partitions.

    Rows are compared where they lie; of each partition its first and last row go on, to be
    compared with those of its neighbours.
    """
    if not df.where(" or ".join(f"`{c}` is null" for c in order)).isEmpty():
        raise ValueError("null in the order")
    rows = df.select(F.struct(*order).alias("_o"), F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i"))
    at = Window.partitionBy("_p").orderBy("_i")
    falls = rows.withColumn("_b", F.lag("_o").over(at)).groupBy("_p").agg(
        F.bool_or(F.coalesce(F.col("_b") > F.col("_o"), F.lit(False))).alias("_f"), F.min_by("_o", "_i").alias("_first"), F.max_by("_o", "_i").alias("_last")
    )
    between = F.lag("_last").over(Window.orderBy("_p")) > F.col("_first")
    if not falls.withColumn("_x", between).where("_f or _x").isEmpty():
        raise ValueError(f"not sorted by {', '.join(order)}")
