"""All non-empty subsets of a list, as a sweep over aggregations or windows wants them."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession


def non_empty_subsets(items: Sequence[str]) -> list[list[str]]:
    """The non-empty subsets, each in the order of the list, sorted."""
    items = list(dict.fromkeys(items))
    return sorted(list(c) for n in range(1, len(items) + 1) for c in combinations(items, n))


def as_choices(subsets: Sequence[Sequence[str]]) -> str:
    """``[a],[a,b],[b]``."""
    return ",".join(f"[{','.join(s)}]" for s in subsets)


def subsets_table(spark: SparkSession, items: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(",".join(s),) for s in non_empty_subsets(items)], "subset string")
