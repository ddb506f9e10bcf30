"""Rolling totals over trailing periods of days, from segment trees.

A *series* is one combination of key columns. Its days are cut into shards of ``shard_days``
(a power of two) days. Each shard with data has one segment tree in heap order: node 1 is the
whole shard, node ``k`` covers the days of nodes ``2k`` and ``2k+1``, node ``shard_days + i`` is
day ``i`` of the shard. Nodes hold a sum (in whole units of ``10**-scale``) and a count.

A trailing window that ends at a day is the union of O(log shard_days) nodes of the day's own
shard and of the shards before it. All trees have the same shape, so the nodes of "day ``j`` of
the shard" are the same for every tree and a batch of trees is queried with column sums.

Nothing here grows with the number of rows of a series: days are summed before anything is
brought together, a tree has a fixed size, and a series has as many trees as its calendar span.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.values import day_number, from_units, to_units
from tallyloom.workspace import staged


def daily_leaves(df: DataFrame, keys: Sequence[str], time: str, value: str, scale: int = 1) -> DataFrame:
    """Sum and count of values for each series and day with values: keys, day, total, n.

    Rows with a null key, time or value count nowhere; other columns are dropped. ``day`` is the
    number of days since 1970-01-01. Partial sums are made before the shuffle.
    """
    rows = df.select(*keys, day_number(F.col(time)).alias("day"), to_units(F.col(value), scale).alias("units"))
    return rows.dropna().groupBy(*keys, "day").agg(F.sum("units").alias("total"), F.count("units").alias("n"))


def _sum_up(nodes: np.ndarray) -> np.ndarray:
    """Fill the inner nodes of trees (rows of ``nodes``) whose leaves are set."""
    low = nodes.shape[1] // 2
    while low > 1:
        half = low // 2
        nodes[:, half:low] = nodes[:, low : 2 * low : 2] + nodes[:, low + 1 : 2 * low : 2]
        low = half
    return nodes


def _cover(first: int, last: int, leaves: int) -> list[int]:
    """The fewest nodes that make up the days first..last of a shard."""
    nodes, low, high = [], first + leaves, last + leaves + 1
    while low < high:
        if low & 1:
            nodes.append(low)
            low += 1
        if high & 1:
            high -= 1
            nodes.append(high)
        low //= 2
        high //= 2
    return nodes


def _tree_schema(leaves: DataFrame, keys: Sequence[str]) -> T.StructType:
    fields = [leaves.schema[k] for k in keys]
    nodes = T.ArrayType(T.LongType(), False)
    return T.StructType(
        [*fields, T.StructField("shard", T.IntegerType()), T.StructField("totals", nodes), T.StructField("counts", nodes)]
    )


def _by_shard(leaves: DataFrame, keys: Sequence[str], shard_days: int) -> DataFrame:
    """Leaves of a shard as one row; at most ``shard_days`` of them, as a day has one leaf."""
    place = F.pmod("day", F.lit(shard_days))
    return (
        leaves.select(*keys, F.floor(F.col("day") / shard_days).cast("int").alias("shard"), place.cast("int").alias("place"), "total", "n")
        .groupBy(*keys, "shard")
        .agg(F.collect_list(F.struct("place", "total", "n")).alias("leaves"))
    )


def build_trees(leaves: DataFrame, keys: Sequence[str], shard_days: int = 64) -> DataFrame:
    """The store: one segment tree per series and shard with data (keys, shard, totals, counts)."""
    if shard_days < 2 or shard_days & (shard_days - 1):
        raise ValueError("shard_days must be a power of two")
    keys = list(keys)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            totals = np.zeros((len(pdf), 2 * shard_days), dtype=np.int64)
            counts = np.zeros_like(totals)
            for i, days in enumerate(pdf["leaves"]):
                for d in days:
                    totals[i, shard_days + d["place"]] += d["total"]
                    counts[i, shard_days + d["place"]] += d["n"]
            out = pdf[[*keys, "shard"]].copy()
            out["totals"] = list(_sum_up(totals))
            out["counts"] = list(_sum_up(counts))
            yield out

    return _by_shard(leaves, keys, shard_days).mapInPandas(build, _tree_schema(leaves, keys))


def correct_trees(trees: DataFrame, corrections: DataFrame, keys: Sequence[str], shard_days: int = 64) -> DataFrame:
    """The store after late corrections: leaves (keys, day, total, n) to be added, signed.

    Of a shard with corrections only the changed days and their ancestors are touched, log2 of
    ``shard_days`` nodes a day; shards without corrections pass through as they are. Corrections
    to days of a shard that has no tree yet make one.
    """
    keys = list(keys)
    on = [*keys, "shard"]

    def amend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept = []
            for column, field in (("totals", "total"), ("counts", "n")):
                rows = []
                for nodes, days in zip(pdf[column], pdf["leaves"], strict=True):
                    nodes = np.zeros(2 * shard_days, dtype=np.int64) if nodes is None else np.array(nodes, dtype=np.int64)
                    for d in days:
                        node = shard_days + d["place"]
                        while node:
                            nodes[node] += d[field]
                            node //= 2
                    rows.append(nodes)
                kept.append(rows)
            out = pdf[on].copy()
            out["totals"], out["counts"] = kept
            yield out

    # Read twice, made once.
    changed = _by_shard(corrections.groupBy(*keys, "day").agg(F.sum("total").alias("total"), F.sum("n").alias("n")), keys, shard_days)
    changed = staged(changed, "changed")
    touched = changed.join(trees, on, "left").mapInPandas(amend, trees.schema)
    return trees.join(changed, on, "left_anti").select(trees.columns).unionByName(touched)


def query_trees(trees: DataFrame, keys: Sequence[str], windows: Sequence[int] = (7, 30), shard_days: int = 64, scale: int = 1) -> DataFrame:
    """For every day of every series, from its first to its last day with data, the trailing totals.

    Columns: keys, day (date), first_day (date), and for each window of W days ``units_W`` (exact,
    in 10**-scale), ``n_W``, ``total_W`` (decimal) and ``avg_W`` (total / W, double). Days without
    rows are there with what their windows hold, zero if nothing.
    """
    keys, windows = list(keys), [int(w) for w in windows]
    if min(windows) < 1:
        raise ValueError("windows are whole days, 1 at least")
    back = -(-(max(windows) - 1) // shard_days)
    # Trees counted to zero by corrections don't bound a series.
    data = trees.where(F.element_at("counts", 2) > 0)
    series = Window.partitionBy(*keys).orderBy("shard")
    leaf = F.slice("counts", shard_days + 1, shard_days)
    place = F.transform(leaf, lambda n, i: F.when(n > 0, i))
    spans = (
        data.withColumn("_lo", F.col("shard") * shard_days + F.array_min(place))
        .withColumn("_hi", F.col("shard") * shard_days + F.array_max(place))
        .withColumn("_next", F.lead("shard").over(series))
        .withColumn("_lo", F.min("_lo").over(Window.partitionBy(*keys)))
        .withColumn("_hi", F.max("_hi").over(Window.partitionBy(*keys)))
    )
    # Shards without data between two with data: as rows without nodes.
    own = F.col("_at") == F.col("shard")
    dense = spans.withColumn("_at", F.explode(F.sequence("shard", F.coalesce(F.col("_next") - 1, F.col("shard"))))).select(
        *keys, F.col("_at").alias("shard"), "_lo", "_hi", F.when(own, F.col("totals")).alias("totals"), F.when(own, F.col("counts")).alias("counts")
    )
    for b in range(1, back + 1):
        dense = dense.withColumn(f"_t{b}", F.lag("totals", b).over(series)).withColumn(f"_c{b}", F.lag("counts", b).over(series))

    plan = {}
    for w in windows:
        for j in range(shard_days):
            parts = []
            for b in range(back + 1):
                first, last = j - w + 1 + b * shard_days, j + b * shard_days
                first, last = max(first, 0), min(last, shard_days - 1)
                if first <= last:
                    parts.append((b, _cover(first, last, shard_days)))
            plan[w, j] = parts

    def stack(column: pd.Series) -> np.ndarray:
        out = np.zeros((len(column), 2 * shard_days), dtype=np.int64)
        for i, nodes in enumerate(column):
            if nodes is not None:
                out[i] = nodes
        return out

    def query(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 2048):
                pdf = whole.iloc[at : at + 2048]
                days = pdf["shard"].to_numpy()[:, None] * shard_days + np.arange(shard_days)[None, :]
                wanted = (days >= pdf["_lo"].to_numpy()[:, None]) & (days <= pdf["_hi"].to_numpy()[:, None])
                row = np.nonzero(wanted)[0]
                out = {k: pdf[k].to_numpy()[row] for k in keys}
                out["day"] = days[wanted]
                out["_lo"] = pdf["_lo"].to_numpy()[row]
                for prefix, name in (("units", "totals"), ("n", "counts")):
                    trees_of = [stack(pdf[name])] + [stack(pdf[f"_{name[0]}{b}"]) for b in range(1, back + 1)]
                    for w in windows:
                        answer = np.zeros((len(pdf), shard_days), dtype=np.int64)
                        for j in range(shard_days):
                            for b, nodes in plan[w, j]:
                                answer[:, j] += trees_of[b][:, nodes].sum(axis=1)
                        out[f"{prefix}_{w}"] = answer[wanted]
                yield pd.DataFrame(out)

    schema = T.StructType(
        [trees.schema[k] for k in keys]
        + [T.StructField("day", T.IntegerType()), T.StructField("_lo", T.IntegerType())]
        + [T.StructField(f"{p}_{w}", T.LongType()) for p in ("units", "n") for w in windows]
    )
    out = dense.mapInPandas(query, schema)
    columns = [*keys, F.date_from_unix_date("day").alias("day"), F.date_from_unix_date("_lo").alias("first_day")]
    for w in windows:
        exact = from_units(F.col(f"units_{w}"), scale)
        columns += [F.col(f"units_{w}"), F.col(f"n_{w}"), exact.alias(f"total_{w}"), (exact.cast("double") / w).alias(f"avg_{w}")]
    return out.select(*columns)


def trailing_totals(
    df: DataFrame,
    keys: Sequence[str] = ("subject_id", "code"),
    time: str = "time",
    value: str = "numeric_value",
    windows: Sequence[int] = (7, 30),
    shard_days: int = 64,
    scale: int = 1,
) -> DataFrame:
    """Totals and daily averages over trailing windows of days, for every day of every series.

    Rows with a null in a key, in time or in value are left out; NaN must have been made null.
    Repeated rows count as often as they are there (see ``live_rows``). Many rows at one time
    simply add up. An empty table gives an empty result. Columns other than those named are
    dropped, whatever they are called.
    """
    leaves = daily_leaves(df, keys, time, value, scale)
    return query_trees(build_trees(leaves, keys, shard_days), keys, windows, shard_days, scale)


def bursts(totals: DataFrame, short: int = 7, long: int = 30, numerator: int = 5, denominator: int = 2) -> DataFrame:
    """Days whose short average is over numerator/denominator times the long one, once ``long`` days are there."""
    s, ell = F.col(f"units_{short}"), F.col(f"units_{long}")
    return totals.where(
        (F.datediff("day", "first_day") >= long - 1) & (s > 0) & (s * (denominator * long) > ell * (numerator * short))
    )
