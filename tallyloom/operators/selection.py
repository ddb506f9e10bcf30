"""Selection of features by their correlation with the label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_correlation(labels: DataFrame, features: DataFrame, by: tuple[str, ...] = ("window", "agg", "code")) -> DataFrame:
    """Pearson's r of each matrix column with the label over all label rows: ``by`` and ``r``.

    ``labels``: subject_id, time, label (numeric or boolean, nulls left out), one row per key;
    ``features``: the long feature table of the same rows, absent cells being zeros. Only sums are
    shuffled: n, Sy and Syy of the labels, Sx, Sxx and Sxy of the cells. ``r`` is null for a
    constant column; ValueError if the label is constant.
    """
    y = labels.select("subject_id", "time", F.col("label").cast("double").alias("_y")).dropna()
    n, sy, syy = y.agg(F.count("*"), F.sum("_y"), F.sum(F.col("_y") * F.col("_y"))).first()
    spread_y = (n * syy - sy * sy) if n else 0
    if not spread_y > 0:
        raise ValueError("the label is constant")
    x = F.col("value")
    sums = features.join(y, ["subject_id", "time"]).groupBy(*by).agg(F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.sum(x * F.col("_y")).alias("sxy"))
    spread_x = n * F.col("sxx") - F.col("sx") * F.col("sx")
    r = (n * F.col("sxy") - F.col("sx") * F.lit(sy)) / F.sqrt(spread_x * F.lit(spread_y))
    return sums.select(*by, F.when(spread_x > 1e-9 * n * F.col("sxx"), r).alias("r"))


def strongest(correlations: DataFrame) -> DataFrame:
    """Each code's strongest column: (code, strength), the greatest absolute r."""
    return correlations.where("r is not null").groupBy("code").agg(F.max(F.abs("r")).alias("strength"))


def select_min_correlation(correlations: DataFrame, least: float) -> DataFrame:
    """Codes with a column whose absolute r is above ``least``."""
    return strongest(correlations).where(F.col("strength") > least).select("code")


def select_max_by_correlation(correlations: DataFrame, most: int) -> DataFrame:
    """The ``most`` codes with the strongest columns, of equal ones the first by code."""
    return strongest(correlations).orderBy(F.desc("strength"), "code").limit(most).select("code")
