"""One row per entity from an event table: sparse count, total and latest-time vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.values import CODE_BLANKS, clean_code, finite, from_units, to_units
from tallyloom.operators.ordering import number_rows
from tallyloom.workspace import staged

#: A dictionary of at most so many spellings is broadcast (some 100 MB at 100 bytes each); a larger one is joined by shuffle.
BROADCAST_SPELLINGS = 1_000_000
MEASURES = ("count", "total", "recency")


def code_index(df: DataFrame, code: str = "code") -> DataFrame:
    """Dictionary of the codes of a table: spelling, code (cleaned), idx (0, 1, ... in order of code).

    One row per spelling; the spellings of a code share its idx. The dictionary is as long as
    there are spellings, not rows; only this list is numbered, in ranges.
    """
    spellings = df.select(F.col(code).alias("spelling")).where(F.col(code).isNotNull()).distinct()
    spellings = staged(spellings.withColumn("code", clean_code(F.col("spelling"))), "spellings")
    numbers = number_rows(spellings.select("code").distinct(), ["code"], "idx")
    return staged(spellings.join(numbers, "code").select("spelling", "code", F.col("idx").cast("int").alias("idx")), "codes")


def _if_small(dictionary: DataFrame) -> DataFrame:
    return F.broadcast(dictionary) if dictionary.count() <= BROADCAST_SPELLINGS else dictionary


def encode_events(
    df: DataFrame, dictionary: DataFrame, subject: str = "subject_id", code: str = "code", time: str = "time", value: str = "numeric_value"
) -> DataFrame:
    """Distinct live rows with time: subject_id, idx, time, numeric_value, codes as indices before the shuffle."""
    events = df.select(
        F.col(subject).cast("long").alias("subject_id"),
        F.col(code).alias("spelling"),
        F.col(time).alias("time"),
        finite(F.col(value)).alias("numeric_value"),
    ).where("subject_id is not null and spelling is not null and time is not null")
    return events.join(_if_small(dictionary.select("spelling", "idx")), "spelling").select("subject_id", "idx", "time", "numeric_value").distinct()


def entity_vectors(events: DataFrame, scale: int = 1) -> DataFrame:
    """Sparse vectors: subject_id and ``vec``, an array of (idx, n, n_values, units, latest) by idx.

    ``units`` is the exact total in 10**-scale, null without values. Counts, totals and latest
    times are merged by (subject, idx) before anything of a subject comes together, so a hot
    subject costs one entry per code. Entries are mergeable: see ``merge_vectors``.
    """
    partial = events.groupBy("subject_id", "idx").agg(
        F.count("*").alias("n"),
        F.count("numeric_value").alias("n_values"),
        F.sum(to_units(F.col("numeric_value"), scale)).alias("units"),
        F.max("time").alias("latest"),
    )
    return _gathered(partial)


def _gathered(partial: DataFrame) -> DataFrame:
    entry = F.struct("idx", "n", "n_values", "units", "latest")
    return partial.groupBy("subject_id").agg(F.sort_array(F.collect_list(entry)).alias("vec"))


def merge_vectors(*parts: DataFrame) -> DataFrame:
    """Vectors of disjoint sets of events (of one dictionary) as those of their union."""
    entries = None
    for p in parts:
        e = p.select("subject_id", F.explode("vec").alias("e")).select("subject_id", "e.*")
        entries = e if entries is None else entries.unionByName(e)
    merged = entries.groupBy("subject_id", "idx").agg(
        F.sum("n").alias("n"), F.sum("n_values").alias("n_values"), F.sum("units").alias("units"), F.max("latest").alias("latest")
    )
    return _gathered(merged)


def top_codes(vectors: DataFrame, dictionary: DataFrame) -> DataFrame:
    """For each subject and measure the code with the most, all tied codes: subject_id, measure, code.

    ``count``: most rows; ``recency``: latest time; ``total``: largest total among codes with a
    value (none if no code has one).
    """

    def best(field: str, measure: str) -> F.Column:
        most = F.array_max(F.transform("vec", lambda e: e[field]))
        return F.transform(F.filter("vec", lambda e: e[field] == most), lambda e: F.struct(F.lit(measure).alias("measure"), e["idx"].alias("idx")))

    tops = vectors.select("subject_id", F.explode(F.concat(best("n", "count"), best("latest", "recency"), best("units", "total"))).alias("t"))
    codes = _if_small(dictionary.select("idx", "code").distinct())
    return tops.select("subject_id", "t.measure", "t.idx").join(codes, "idx").select("subject_id", "measure", "code")


def long_features(vectors: DataFrame, dictionary: DataFrame, scale: int = 1) -> DataFrame:
    """The vectors as rows: subject_id, code, n, total (decimal, null without values), latest."""
    codes = _if_small(dictionary.select("idx", "code").distinct())
    rows = vectors.select("subject_id", F.explode("vec").alias("e")).select("subject_id", "e.*")
    return rows.join(codes, "idx").select("subject_id", "code", "n", from_units(F.col("units"), scale).alias("total"), "latest")


def expand_columns(vectors: DataFrame, dictionary: DataFrame, measures: Sequence[str] = MEASURES, scale: int = 1, codes: Sequence[str] | None = None) -> DataFrame:
    """One row per subject with a column ``<code>/<measure>`` for each code and measure.

    Columns are in order of code, then of ``measures``. count is 0 and total and recency are
    null for codes that a subject lacks. The columns are those of ``codes`` or of the whole
    dictionary, whose codes (hundreds to thousands) are read by the driver to name them; rows
    are filled in batches, straight from the sparse entries.
    """
    known = dictionary.select("idx", "code").distinct()
    if codes is not None:
        known = known.where(F.col("code").isin(list(codes)))
    columns = [(r["idx"], r["code"]) for r in known.orderBy("idx").collect()]
    place = {idx: i for i, (idx, _) in enumerate(columns)}
    kinds = {"count": ("n", T.LongType()), "total": ("units", T.DoubleType()), "recency": ("latest", T.TimestampNTZType())}
    schema = T.StructType(
        [vectors.schema["subject_id"]] + [T.StructField(f"{c}/{m}", kinds[m][1]) for _, c in columns for m in measures]
    )
    measures = list(measures)
    lookup = np.full(max(place, default=0) + 1, -1)
    for idx, i in place.items():
        lookup[idx] = i
    arrow = {"count": pa.int64(), "total": pa.float64(), "recency": pa.timestamp("us")}

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, vec = part.num_rows, part.column("vec")
                ends = np.asarray(vec.offsets)
                row = np.repeat(np.arange(rows), np.diff(ends))
                entries = vec.flatten()
                col_of = lookup[np.minimum(np.asarray(entries.field("idx")), len(lookup) - 1)] if len(entries) else np.array([], dtype=int)
                known_entry = col_of >= 0
                r, c = row[known_entry], col_of[known_entry]
                dense = {}
                for m in measures:
                    field = entries.field(kinds[m][0])
                    raw = field.cast(pa.int64()) if m != "recency" else field.cast(pa.timestamp("us")).cast(pa.int64())
                    there = np.asarray(raw.is_valid())[known_entry]
                    numbers = np.asarray(raw.fill_null(0))[known_entry]
                    value = np.zeros((len(columns), rows), dtype=np.int64)
                    has = np.zeros((len(columns), rows), dtype=bool)
                    value[c, r] = numbers
                    has[c, r] = there
                    dense[m] = (value, has)
                out = [part.column("subject_id")]
                for i in range(len(columns)):
                    for m in measures:
                        value, has = dense[m]
                        if m == "count":
                            out.append(pa.array(value[i], pa.int64()))
                        elif m == "total":
                            out.append(pa.array(value[i] / 10**scale, pa.float64(), mask=~has[i]))
                        else:
                            out.append(pa.array(value[i], pa.int64(), mask=~has[i]).cast(arrow[m]))
                yield pa.RecordBatch.from_arrays(out, names=schema.fieldNames())

    entry = F.transform("vec", lambda e: F.struct(e["idx"].alias("idx"), e["n"].alias("n"), e["units"].alias("units"), e["latest"].cast("timestamp_ntz").alias("latest")))
    return vectors.select("subject_id", entry.alias("vec")).mapInArrow(fill, schema)


def feature_table(df: DataFrame, scale: int = 1, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(vectors, dictionary) of an event table; expand with ``long_features`` or ``expand_columns``.

    Rows without subject, code or time are left out, repeated rows count once, NaN is null, and
    columns other than the four named are dropped. An empty table gives no rows.
    """
    dictionary = code_index(df, columns.get("code", "code"))
    return entity_vectors(encode_events(df, dictionary, **columns), scale), dictionary
