"""How often every distinct term occurs, in how many records, and which terms are too rare or too common."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.values import clean_code, finite


def term_counts(rows: DataFrame, record: str, term: str) -> DataFrame:
    """Per record and term how often it is there: record, term, n. Rows with a null in either are left out.

    Each task counts in a hash table before the shuffle, so that a record with a third of all
    rows moves one partial count per task and term.
    """
    return rows.select(F.col(record).alias("record"), F.col(term).alias("term")).dropna().groupBy("record", "term").agg(F.count("*").alias("n"))


def distinct_term_counts(rows: DataFrame, record: str, term: str, rest: Sequence[str], hot: Sequence = ()) -> DataFrame:
    """``term_counts`` of the distinct rows: those that agree in record, cleaned term and the columns ``rest`` count once.

    NaN in ``rest`` is null, and nulls agree. Rows are partitioned once, by record and term, and
    both told apart and counted there. Rows of the ``hot`` records, a short list, are told apart
    by the hash of all columns instead, so that none is brought together, and their counts, one
    per task and pair, move once more.
    """
    kept = [finite(F.col(c)).alias(c) if dict(rows.dtypes)[c] in ("double", "float") else F.col(c) for c in rest]
    chosen = rows.select(F.col(record).alias("record"), clean_code(F.col(term)).alias("term"), *kept).where("record is not null and term is not null")

    def counted(part: DataFrame) -> DataFrame:
        return part.distinct().groupBy("record", "term").agg(F.count("*").alias("n"))

    if not hot:
        return counted(chosen.repartition("record", "term"))
    is_hot = F.col("record").isin(list(hot))
    return counted(chosen.where(~is_hot).repartition("record", "term")).unionByName(counted(chosen.where(is_hot)))


def marked(counts: DataFrame, n_records: int, min_count: int = 10, min_records: int = 3, max_share: tuple[int, int] = (4, 5)) -> DataFrame:
    """Per term of (record, term, n): ``n`` occurrences, ``n_records`` records with it, ``mark`` rare, common or null.

    ``rare``: under ``min_count`` occurrences or ``min_records`` records; else ``common``: in more
    than ``max_share`` (a fraction) of the ``n_records`` records there are.
    """
    totals = counts.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("n_records"))
    over, under = max_share
    rare = (F.col("n") < min_count) | (F.col("n_records") < min_records)
    common = F.col("n_records") * under > n_records * over
    return totals.withColumn("mark", F.when(rare, "rare").when(common, "common"))


def term_frequencies(
    rows: DataFrame, record: str, term: str, n_records: int, min_count: int = 10, min_records: int = 3, max_share: tuple[int, int] = (4, 5)
) -> DataFrame:
    """``marked`` of ``term_counts``: term, n, n_records, mark.

    Repeated rows count as often as they are there, an empty table gives no terms, and other
    columns are dropped. The counts of a term are summed per task over its records and summed
    again, so that a term of all records moves one partial count per task.
    """
    return marked(term_counts(rows, record, term), n_records, min_count, min_records, max_share)
