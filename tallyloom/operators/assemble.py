"""From the long feature table to vectors: blocks, column names, sparse and dense rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.names import column_name, split_name
from tallyloom.schema import STATIC_AGGS, kind_of


def blocks(windows: Sequence[str], aggs: Sequence[str]) -> list[tuple[str | None, str]]:
    """The (window, agg) blocks of a matrix in order of their path ``<window or none>/<agg>``; statics have no window."""
    for a in aggs:
        kind_of(a)
    pairs = [(None, a) for a in aggs if a in STATIC_AGGS] + [(w, a) for w in windows for a in aggs if a not in STATIC_AGGS]
    return sorted(pairs, key=lambda b: f"{b[0] or 'none'}/{b[1]}")


def column_table(features: Sequence[str], windows: Sequence[str], aggs: Sequence[str]) -> list[tuple[int, str | None, str, str, str]]:
    """The matrix's columns in order: (idx, window, agg, code, name), each block with its kind's features, sorted."""
    out = []
    for window, agg in blocks(windows, aggs):
        for feature in sorted(f for f in features if split_name(f)[1] == kind_of(agg)):
            out.append((len(out), window, agg, split_name(feature)[0], column_name(feature, agg, window)))
    return out


def column_names(features: Sequence[str], windows: Sequence[str], aggs: Sequence[str], indices: Sequence[int] | None = None) -> list[str]:
    """Names of the matrix's columns, or of those at ``indices``."""
    names = [c[4] for c in column_table(features, windows, aggs)]
    return names if indices is None else [names[i] for i in indices]


def indexed_cells(features: DataFrame, columns: Sequence[tuple]) -> DataFrame:
    """The feature table's cells with ``idx``, their column; zeros, NaN and cells of no column go.

    The table of columns is as long as the selected features times windows; the planner decides
    by its size how to join it.
    """
    spark = features.sparkSession
    table = spark.createDataFrame([(i, w or "none", a, c) for i, w, a, c, _ in columns], "idx int, window string, agg string, code string")
    cells = features.withColumn("window", F.coalesce("window", F.lit("none"))).where((F.col("value") != 0) & ~F.isnan("value"))
    return cells.join(table, ["window", "agg", "code"]).drop("window", "agg", "code")


def sparse_vectors(rows: DataFrame, features: DataFrame, columns: Sequence[tuple], keys: Sequence[str] = ("subject_id", "time")) -> DataFrame:
    """Each row of ``rows`` with a sparse vector ``features``; rows without cells get an empty one.

    Cells of a row are sorted in the engine; the finished lists are wrapped as vectors in Arrow
    batches, without a look at any of them.
    """
    keys = list(keys)
    cells = indexed_cells(features, columns).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("_cells"))
    width, kept = len(columns), len(rows.columns)
    lists = [F.coalesce(F.col(f"_cells.{c}"), F.array().cast(f"array<{t}>")).alias(f"_{c}") for c, t in (("idx", "int"), ("value", "double"))]
    joined = rows.join(cells, keys, "left").select(*[F.col(f"`{c}`") for c in rows.columns], *lists)

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, size = pa.array(np.zeros(b.num_rows, dtype=np.int8)), pa.array(np.full(b.num_rows, width, dtype=np.int32))
            vector = pa.StructArray.from_arrays([kind, size, b.column(kept), b.column(kept + 1)], ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], vector], names=[*b.schema.names[:kept], "features"])

    return joined.mapInArrow(wrap, T.StructType([*rows.schema.fields, T.StructField("features", VectorUDT())]))


def dense_columns(rows: DataFrame, features: DataFrame, columns: Sequence[tuple], keys: Sequence[str] = ("subject_id", "time")) -> DataFrame:
    """Each row with one double column per matrix column, 0 where there is no cell. For few columns."""
    keys = list(keys)
    wide = indexed_cells(features, columns).groupBy(*keys).agg(*[F.sum(F.when(F.col("idx") == i, F.col("value"))).alias(f"_{i}") for i, *_ in columns])
    return rows.join(wide, keys, "left").select(*[F.col(f"`{c}`") for c in rows.columns], *[F.coalesce(f"_{i}", F.lit(0.0)).alias(name) for i, _, _, _, name in columns])
