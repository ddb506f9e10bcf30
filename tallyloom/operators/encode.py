"""Events as cells of a matrix, before any aggregation, and matrices as coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.names import bare_code, kind_column
from tallyloom.operators.features import feature_index, numbered_index
from tallyloom.schema import kind_of


def _columns(selected: DataFrame, kind: str) -> DataFrame:
    index = feature_index(selected).withColumn("_kind", kind_column(F.col("code"))).where(F.col("_kind") == kind)
    return index.select(bare_code(F.col("code")).alias("code"), F.col("position").alias("col"))


def indices_of(selected: DataFrame, agg: str) -> DataFrame:
    """Positions, in the sorted list of all selected features, of those an aggregation reads: (code, position)."""
    return feature_index(selected).where(kind_column(F.col("code")) == kind_of(agg))


def code_cells(events: DataFrame, index: DataFrame, selected: DataFrame) -> DataFrame:
    """(row, col, value): 1 for each event at its index row and its code's column. Repeats stay apart."""
    rows = numbered_index(index).withColumnRenamed("event_id", "row")
    cells = events.where("time is not null and code is not null").join(_columns(selected, "code"), "code")
    return cells.join(rows, ["subject_id", "time"]).select("row", "col", F.lit(1.0).alias("value"))


def value_cells(events: DataFrame, index: DataFrame, selected: DataFrame) -> DataFrame:
    """(row, col, value): each event's value, where it has one, at its index row and its code's column."""
    rows = numbered_index(index).withColumnRenamed("event_id", "row")
    cells = events.where("time is not null and code is not null and numeric_value is not null").join(_columns(selected, "value"), "code")
    return cells.join(rows, ["subject_id", "time"]).select("row", "col", F.col("numeric_value").alias("value"))


def event_cells(events: DataFrame, index: DataFrame, selected: DataFrame, agg: str) -> DataFrame:
    """The cells an aggregation over windows starts from; ValueError for one that has none."""
    kind = kind_of(agg)
    if kind not in ("code", "value"):
        raise ValueError(f"{agg!r} isn't made from events")
    return code_cells(events, index, selected) if kind == "code" else value_cells(events, index, selected)


def to_coordinates(cells: DataFrame) -> DataFrame:
    """Cells as stored coordinates (data, row, col): zeros, NaN and nulls aren't stored, numbers no wider than they need be."""
    kept = cells.where("value is not null and value <> 0 and not isnan(value)")
    return kept.select(F.col("value").cast("float").alias("data"), F.col("row").cast("long").alias("row"), F.col("col").cast("int").alias("col"))


def from_coordinates(stored: DataFrame) -> DataFrame:
    """Cells from stored coordinates; ValueError unless they have data, row and col."""
    if sorted(stored.columns) != ["col", "data", "row"]:
        raise ValueError("coordinates have the columns data, row and col")
    return stored.select("row", "col", F.col("data").cast("double").alias("value"))


def dense_rows(cells: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(row, values): each row of ``rows`` (row) as an array of ``width`` doubles, absent cells 0, repeats added up."""
    summed = cells.groupBy("row", "col").agg(F.sum("value").alias("v")).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "v"))).alias("_m"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at("_m", i), F.lit(0.0)))
    empty = F.array_repeat(F.lit(0.0), width)
    return rows.select("row").join(summed, "row", "left").select("row", F.when(F.col("_m").isNull(), empty).otherwise(filled).alias("values"))
