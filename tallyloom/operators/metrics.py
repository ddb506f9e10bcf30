"""Exact area under the ROC curve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.ordering import running_total


def auc(scores: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row, ``auc``: the share of pairs of a positive and a negative that are in the right order, ties half.

    Rows with a null label or score are left out; 0.0 if a class is missing. Counts per distinct
    score are summed in order over ranges of scores, so nothing is sorted in one task.
    """
    rows = scores.select(F.col(label).cast("int").alias("y"), F.col(score).cast("double").alias("s")).dropna()
    per_score = rows.groupBy("s").agg(F.sum("y").cast("long").alias("p"), (F.count("*") - F.sum("y")).cast("long").alias("n"))
    ranked = running_total(per_score, ["s"], F.col("n"), "upto")
    wins = F.sum(F.col("p").cast("decimal(38,0)") * (2 * (F.col("upto") - F.col("n")) + F.col("n")))
    pairs = F.sum("p") * F.sum("n")
    return ranked.agg(F.coalesce(F.when(pairs > 0, wins.cast("double") / (2 * pairs.cast("double"))), F.lit(0.0)).alias("auc"))


def auc_value(scores: DataFrame, label: str = "label", score: str = "score") -> float:
    return float(auc(scores, label, score).first()[0])
