"""Labels of a prediction task: de-duplicated, aligned with index rows, and joined to features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.asof import latest_before
from tallyloom.operators.features import numbered_index
from tallyloom.operators.rolling import rolling_features
from tallyloom.schema import ROLLING_AGGS


def rename_label_columns(labels: DataFrame, label_column: str = "boolean_value") -> DataFrame:
    """``prediction_time`` as ``time`` and the label column as ``label``."""
    return labels.withColumnRenamed("prediction_time", "time").withColumnRenamed(label_column, "label")


def first_labels(labels: DataFrame, order: Sequence[str]) -> DataFrame:
    """The first label of each (subject_id, time), by an explicit order; null subjects or times go."""
    first = F.min_by(F.struct(*[c for c in labels.columns if c not in ("subject_id", "time")]), F.struct(*order))
    rows = labels.where("subject_id is not null and time is not null").groupBy("subject_id", "time").agg(first.alias("_f"))
    return rows.select("subject_id", "time", "_f.*")


def labels_of_known_subjects(labels: DataFrame, index: DataFrame) -> DataFrame:
    """Labels whose subject has an index row."""
    return labels.join(index.select("subject_id").distinct(), "subject_id", "left_semi")


def align_labels(labels: DataFrame, index: DataFrame) -> DataFrame:
    """Labels of known subjects with ``event_time``, the latest index row at or before them, and its ``event_id``.

    ``event_id`` is -1 and ``event_time`` null where a label comes before all history.
    """
    found = latest_before(labels_of_known_subjects(labels, index), index)
    numbers = numbered_index(index).withColumnRenamed("time", "event_time")
    out = found.join(numbers, ["subject_id", "event_time"], "left")
    return out.select(*labels.columns, "event_time", F.coalesce("event_id", F.lit(-1)).cast("long").alias("event_id"))


def label_features(labels: DataFrame, events: DataFrame, windows: Sequence[str], aggs: Sequence[str] = ROLLING_AGGS, scale: int | None = None, anchor: str = "event") -> DataFrame:
    """Rolling features for label rows: subject_id, time (of the label), code, window and aggregations.

    ``anchor="event"``: the window ends at the latest event at or before the label, which is how
    the store is cached. ``anchor="label"``: it ends at the label's own time. Only the rows that
    labels ask for are computed.
    """
    if anchor not in ("event", "label"):
        raise ValueError("anchor is 'event' or 'label'")
    rows = labels.select("subject_id", "time").where("subject_id is not null and time is not null").distinct()
    if anchor == "label":
        return rolling_features(rows, events, windows, aggs, scale)
    times = events.select("subject_id", "time")
    found = latest_before(rows, times).where("event_time is not null")
    wanted = found.select("subject_id", F.col("event_time").alias("time")).distinct()
    features = rolling_features(wanted, events, windows, aggs, scale).withColumnRenamed("time", "event_time")
    return found.join(features, ["subject_id", "event_time"]).drop("event_time")


def gather_rows(aligned: DataFrame, features: DataFrame, by_label: bool = False) -> DataFrame:
    """The long feature table's cells of the index rows that labels are aligned with.

    ``aligned`` as from ``align_labels``; a label row whose event has no cells, or which has no
    event (-1), has no rows here and is a row of zeros once vectors are made. ``by_label``: the
    table's rows are those of labels, at the labels' own times, rather than of events.
    """
    at = "time" if by_label else "event_time"
    rows = aligned.where("event_time is not null").select("subject_id", F.col("time").alias("_label"), F.col(at).alias("time"))
    return rows.join(features, ["subject_id", "time"]).drop("time").withColumnRenamed("_label", "time")


def binarized(labels: DataFrame, column: str = "label") -> DataFrame:
    """The label as 1 where it is above zero (or true), else 0; null stays null."""
    return labels.withColumn(column, (F.col(column).cast("double") > 0).cast("int"))


def classes(labels: DataFrame, column: str = "label") -> list:
    """The distinct labels, sorted."""
    return sorted(r[0] for r in labels.select(column).dropna().distinct().collect())


def labels_per_class(labels: DataFrame, column: str = "label") -> DataFrame:
    return labels.groupBy(column).agg(F.count("*").alias("n")).orderBy(column)
