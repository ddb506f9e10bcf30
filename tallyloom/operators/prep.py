"""Imputing and scaling of the long feature table.

Scaling doesn't centre, so absent cells, being zeros, stay absent. Statistics cover all rows.
``n_rows`` is the number of matrix rows, cells or not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMN = ("window", "agg", "code")


def standard_scale(features: DataFrame, n_rows: int, fit_on: DataFrame | None = None) -> DataFrame:
    """Each cell divided by its column's population standard deviation, absent cells counting as zeros.

    A column without spread is left as it is. ``fit_on``: the cells to take the statistics from.
    """
    fit = features if fit_on is None else fit_on
    mean, square = F.sum("value") / n_rows, F.sum(F.col("value") * F.col("value")) / n_rows
    spread = fit.groupBy(*COLUMN).agg(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("_d"))
    return _divided(features, spread)


def max_abs_scale(features: DataFrame, fit_on: DataFrame | None = None) -> DataFrame:
    """Each cell divided by its column's greatest absolute value."""
    fit = features if fit_on is None else fit_on
    return _divided(features, fit.groupBy(*COLUMN).agg(F.max(F.abs("value")).alias("_d")))


def _divided(features: DataFrame, divisor: DataFrame) -> DataFrame:
    scaled = features.join(divisor, list(COLUMN), "left")
    by = F.when(F.col("_d") > 0, F.col("_d")).otherwise(1.0)
    return scaled.withColumn("value", F.col("value") / by).select(features.columns)


def fill_values(features: DataFrame, strategy: str, fit_on: DataFrame | None = None, n_rows: int | None = None) -> DataFrame:
    """What stands for a missing cell of each column: (window, agg, code, fill).

    ``mean``, ``median`` (the mean of the middle two) or ``mode`` (of equally frequent values
    the smallest). Without ``n_rows`` over the cells that are there; with it absent cells count
    as zeros, as in the stored matrix.
    """
    fit = features if fit_on is None else fit_on
    if strategy == "mean":
        total = F.sum("value") / n_rows if n_rows else F.avg("value")
        return fit.groupBy(*COLUMN).agg(total.alias("fill"))
    counts = fit.groupBy(*COLUMN, "value").agg(F.count("*").alias("n"))
    if n_rows:
        absent = fit.groupBy(*COLUMN).agg((F.lit(n_rows) - F.count("*")).alias("n")).withColumn("value", F.lit(0.0)).where("n > 0")
        counts = counts.unionByName(absent).groupBy(*COLUMN, "value").agg(F.sum("n").alias("n"))
    if strategy == "mode":
        return counts.groupBy(*COLUMN).agg(F.max(F.struct("n", (-F.col("value")).alias("v"))).alias("_m")).select(*COLUMN, (-F.col("_m.v")).alias("fill"))
    if strategy != "median":
        raise ValueError("strategy is mean, median or mode")
    return counts.groupBy(*COLUMN).agg(F.percentile("value", F.lit(0.5), F.col("n")).alias("fill"))


def impute(rows: DataFrame, features: DataFrame, strategy: str, keys: Sequence[str] = ("subject_id", "time"), fit_on: DataFrame | None = None) -> DataFrame:
    """The feature table with a cell for every row and column, missing ones filled.

    The result is dense, rows times columns, so it is for the few columns a model is left with.
    """
    keys = list(keys)
    fills = fill_values(features, strategy, fit_on)
    # The columns are one list, a scalar to each row.
    listed = fills.agg(F.collect_list(F.struct(*COLUMN, "fill"))).scalar()
    every = rows.select(*keys).distinct().select(*keys, F.explode(listed).alias("_c")).select(*keys, "_c.*")
    out = every.join(features, [*keys, *COLUMN], "left")
    return out.select(*keys, *COLUMN, F.coalesce("value", "fill").alias("value"))
