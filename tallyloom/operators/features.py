"""Selection of features by frequency, and what it does to observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.names import bare_code, kind_column, without_last_part_column
from tallyloom.operators.ordering import number_rows
from tallyloom.schema import STATIC_AGGS, kind_of


def select_features(
    frequencies: DataFrame, allowed: Sequence[str] | None = None, min_count: int | None = None, min_frequency: float | None = None, max_features: int | None = None
) -> DataFrame:
    """The frequency table of the selected features.

    Filters in this order: the allowed names; share of the sum of counts of what is left, at
    least ``min_frequency`` (0 to 1); count, at least ``min_count``; the ``max_features`` most
    frequent, of equal ones the first by name. Names with null counts are never frequent.
    """
    out = frequencies.select("code", "count")
    if allowed is not None:
        out = out.where(F.col("code").isin(list(allowed)))
    if min_frequency is not None:
        if not 0 <= min_frequency <= 1:
            raise ValueError("a frequency lies between 0 and 1")
        out = out.where(F.col("count") / out.agg(F.sum("count")).scalar() >= min_frequency)
    if min_count is not None:
        out = out.where(F.col("count") >= min_count)
    if max_features is not None:
        out = out.orderBy(F.desc_nulls_last("count"), "code").limit(max_features)
    return out


def selected_names(selected: DataFrame) -> list[str]:
    """The selected features' names, sorted, on the driver; ValueError if none is left."""
    names = sorted(r[0] for r in selected.select("code").distinct().collect())
    if not names:
        raise ValueError("no feature is left after selection")
    return names


def restrict_metadata(frequencies: DataFrame, selected: DataFrame) -> DataFrame:
    """The rows of a frequency table whose names are selected."""
    return frequencies.join(selected.select("code").distinct(), "code", "left_semi")


def features_of(selected: DataFrame, agg: str) -> DataFrame:
    """The features that an aggregation reads; ValueError for an unknown one."""
    return selected.where(kind_column(F.col("code")) == kind_of(agg))


def feature_index(selected: DataFrame) -> DataFrame:
    """Each feature's place in the sorted list of names: (code, position from 0)."""
    return number_rows(selected.select("code").distinct(), ["code"], "position")


def drop_rare(observations: DataFrame, selected: DataFrame) -> DataFrame:
    """Observations without what isn't selected.

    A value is nulled unless the code's ``/value`` (with time) or ``/static/first`` (without) is
    selected; a row is dropped unless its ``/code`` or ``/static/present`` is. Rows without code
    go too. One join with the list of selected names, one row per code.
    """
    kinds = (
        selected.select(bare_code(F.col("code")).alias("code"), kind_column(F.col("code")).alias("_kind"))
        .groupBy("code")
        .agg(*[F.bool_or(F.col("_kind") == k).alias(f"_{i}") for i, k in enumerate(("code", "value", "static/present", "static/first"))])
    )
    static = F.col("time").isNull()
    keep_row = F.when(static, F.col("_2")).otherwise(F.col("_0"))
    keep_value = F.when(static, F.col("_3")).otherwise(F.col("_1"))
    kept = observations.join(kinds, "code").where(keep_row)
    return kept.withColumn("numeric_value", F.when(keep_value, F.col("numeric_value"))).select(observations.columns)


def events_of(observations: DataFrame, selected: DataFrame) -> DataFrame:
    """Rows with time of codes that are selected as events.

    A feature counts with its name less the last part, so that ``X/static/present`` stands for
    ``X/static`` and a code that is selected as a timeless fact only has no events.
    """
    codes = selected.select(without_last_part_column(F.col("code")).alias("code")).distinct()
    return observations.where("time is not null and code is not null").join(codes, "code", "left_semi").select(observations.columns)


def event_index(events: DataFrame) -> DataFrame:
    """The distinct (subject_id, time) of events: the rows of the feature matrix. ValueError on a null time."""
    if "time" not in events.columns:
        raise ValueError("events need a time")
    return events.select("subject_id", "time").where("time is not null and subject_id is not null").distinct()


def numbered_index(index: DataFrame) -> DataFrame:
    """Index rows with ``event_id``, their number in order of subject and time from 0."""
    return number_rows(index, ["subject_id", "time"], "event_id")


def is_static(agg: str) -> bool:
    return agg in STATIC_AGGS
