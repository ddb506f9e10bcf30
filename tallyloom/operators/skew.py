"""Per-key results where a few keys hold most rows.

``key_quantiles`` gives exact per-key quantiles by distributed selection: mergeable histograms of
each key's values are refined, round by round, around the wanted ranks until every rank is
resolved to one value. The values of a key are never brought together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.values import finite
from tallyloom.workspace import staged


def hot_and_all(df: DataFrame, key: str, share: int = 1000, least: int = 10_000) -> tuple[list, int]:
    """Keys with more than one in ``share`` of all rows, and more than ``least``: fewer than ``share`` of them, by arithmetic; and how many keys there are, nulls apart."""
    limit = max(least, df.count() // share)
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count()
    found = counts.agg(F.collect_list(F.when(F.col("count") > limit, F.col(key))), F.count("*")).first()
    return list(found[0]), found[1]


def hot_keys(df: DataFrame, key: str, share: int = 1000, least: int = 10_000) -> list:
    """The hot keys of ``hot_and_all``."""
    return hot_and_all(df, key, share, least)[0] if df.count() > least else []


def skew_lookup(left: DataFrame, key: str, right: DataFrame, right_key: str, columns: Sequence[str], hot: list | None = None) -> DataFrame:
    """Left join with a table that has each key once, without one task per hot key of ``left``.

    Rows of the ``hot`` keys (those of ``hot_keys`` unless given) are matched by a broadcast of
    those keys' rows, fewer than 1000 whatever the size of the data; all other rows by an
    ordinary join. Null keys find nothing.
    """
    hot = hot_keys(left, key) if hot is None else hot
    found = right.select(F.col(right_key).alias("_k"), *columns)

    def joined(rows: DataFrame, table: DataFrame) -> DataFrame:
        return rows.join(table, rows[key] == table["_k"], "left").drop("_k")

    if not hot:
        return joined(left, found)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return joined(left.where(~is_hot), found).unionByName(
        joined(left.where(is_hot), F.broadcast(found.where(F.col("_k").isin(hot))))
    )


def _coarse(v: Column) -> Column:
    """A bucket for any finite double that never falls as the value grows: 16 to a power of two."""
    size = F.floor(F.log2(F.abs(v)) * 16).cast("int") + 20_000
    return F.when(v == 0, 0).when(v > 0, size).otherwise(-size)


def _fine(v: Column, low: Column, high: Column, buckets: int) -> Column:
    """The bucket of v among equal parts of low..high; the ends always fall apart."""
    part = F.floor((v - low) / (high - low) * buckets).cast("int")
    return F.when(v == low, -1).when(v == high, buckets).otherwise(F.least(F.greatest(part, F.lit(0)), F.lit(buckets - 1)))


def key_quantiles(
    df: DataFrame,
    key: str = "subject_id",
    value: str = "numeric_value",
    probs: Sequence[float] = (0.25, 0.5, 0.75),
    buckets: int = 1024,
    salts: int = 32,
    least_hot: int = 100_000,
) -> DataFrame:
    """Exact quantiles of ``value`` for every key, one row per key (null keys form a key of their own).

    Columns: the key, ``n_rows`` (all rows, repeats and nulls included), ``n_values``, and one
    column ``q<percent>`` per probability: the smallest value with at least that share of the
    key's values at or below it. Null, NaN and infinite values count as rows only; a key without
    values has null quantiles; ties need no rule, as equal values are one value. An empty table
    gives an empty result. Other columns are dropped.

    Method. Rows are first counted by (key, value) in each task, then over all: *cells*, spread
    by the hash of both, so that a hot key's values lie in all partitions. Round one counts a
    histogram of 16 buckets to a power of two for each key and finds each rank's bucket. Later
    rounds part each such bucket into ``buckets`` equal pieces between its least and greatest
    value and count again, until least equals greatest. A rank carries the values below and above
    its bucket with it, and ``n_rows`` and ``n_values`` are what a resolved rank adds up to:
    those below, its own bucket's, those above, and the rows without a value.

    A round's piece is 1/``buckets`` as wide as the last, so that a double is resolved within
    seven rounds. After round one only the cells of buckets in work are kept and moved. They meet
    their buckets by key and bucket; the cells of hot keys (with more than ``least_hot`` and one in
    1000 of all cells there, so fewer than 1000 keys) also by a salt, the hash of the value, so that one bucket with a third of all rows is shared out over
    ``salts`` tasks.
    """
    names = {p: f"q{p * 100:g}".replace(".", "_") for p in probs}
    # As a struct of one field a null key is equal to itself, in joins too.
    chosen = df.select(F.struct(F.col(key).alias("k")).alias("k"), finite(F.col(value)).alias("v"))
    cells = staged(chosen.groupBy("k", "v").agg(F.count("*").alias("c")), "cells")
    counted = [F.sum("c").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.count("*").alias("cells")]
    # The bucket of rows without a value is null, and lies before all others.
    first = staged(cells.groupBy("k", _coarse(F.col("v")).alias("bucket")).agg(*counted), "histogram")
    targets = F.explode(F.array(*[F.struct(F.lit(names[p]).alias("target"), F.lit(float(p)).alias("p")) for p in probs])).alias("t")
    has_value = F.col("bucket").isNotNull()
    sizes = first.groupBy("k").agg(F.sum(F.when(has_value, F.col("n"))).alias("values"), F.coalesce(F.sum(F.when(~has_value, F.col("n"))), F.lit(0)).alias("without"))
    wanted = sizes.where("values > 0").select("k", "values", targets)
    wanted = wanted.select("k", "t.target", F.greatest(F.lit(1), F.ceil(F.col("t.p") * F.col("values"))).cast("long").alias("rank"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("above"))

    def narrowed(histogram: DataFrame, work: DataFrame, on: list[str]) -> DataFrame:
        """For each rank the bucket that holds it. A key's histogram is short: a bounded window."""
        upto = Window.partitionBy(*on).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        h = histogram.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(*on)))
        before = F.col("upto") - F.col("n")
        return (
            work.join(h, on)
            .where((F.col("upto") >= F.col("rank")) & (before < F.col("rank")))
            .select(
                "k", "target", (F.col("rank") - before).alias("rank"), (F.col("below") + before).alias("below"), (F.col("above") + F.col("all") - F.col("upto")).alias("above"),
                F.col("n").alias("same"), F.col("least").alias("low"), F.col("most").alias("high"), *(["bucket"] if on == ["k"] else [F.col("low").alias("was_low"), F.col("high").alias("was_high"), "bucket"]),
            )
        )

    state = staged(narrowed(first.where(has_value), wanted, ["k"]), "ranks")
    done = [state.where("low = high")]
    state = state.where("low < high")
    open_cells = None
    while not state.isEmpty():
        if open_cells is None:
            # Keys with most cells in the buckets in work; their rows and those of the buckets are told apart by a salt.
            sums = first.join(state.select("k", "bucket").distinct(), ["k", "bucket"], "left_semi").groupBy("k").agg(F.sum("cells").alias("cells"))
            total, name = cells.count(), F.coalesce(F.col("k.k").cast("string"), F.lit("null"))
            hot = sums.where(F.col("cells") > max(least_hot, total // 1000)).select(name).collect() if total > least_hot else []
            salted = F.array_contains(F.array(*[F.lit(r[0]) for r in hot]).cast("array<string>"), name)
            many = F.when(salted, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
            work = state.select("k", "bucket", "low", "high").distinct().withColumn("salt", F.explode(many))
            own = F.when(salted, F.pmod(F.hash("v"), F.lit(salts))).otherwise(0)
            left = cells.where(F.col("v").isNotNull()).withColumn("bucket", _coarse(F.col("v"))).withColumn("salt", own)
            found = left.join(work, ["k", "bucket", "salt"])
        else:
            work = state.select("k", F.col("was_low").alias("low"), F.col("was_high").alias("high"), "bucket", F.col("low").alias("l"), F.col("high").alias("h")).distinct()
            left = staged(open_cells, "open").withColumn("bucket", _fine(F.col("v"), F.col("low"), F.col("high"), buckets))
            found = left.join(work, ["k", "low", "high", "bucket"]).select("k", F.col("l").alias("low"), F.col("h").alias("high"), "v", "c")
        open_cells = found.select("k", "low", "high", "v", "c")  # written once another round needs them
        histogram = open_cells.groupBy("k", "low", "high", _fine(F.col("v"), F.col("low"), F.col("high"), buckets).alias("bucket")).agg(*counted)
        state = staged(narrowed(histogram, state.drop("bucket", "was_low", "was_high"), ["k", "low", "high"]), "ranks")
        done.append(state.where("low = high"))
        state = state.where("low < high")
    resolved = done[0].select("k", "target", "low", "below", "same", "above")
    for part in done[1:]:
        resolved = resolved.unionByName(part.select("k", "target", "low", "below", "same", "above"))
    wide = resolved.groupBy("k").agg(
        F.max(F.col("below") + F.col("same") + F.col("above")).alias("n_values"), *[F.max(F.when(F.col("target") == n, F.col("low"))).alias(n) for n in names.values()]
    )
    n_values = F.coalesce("n_values", F.lit(0).cast("long"))
    return sizes.select("k", "without").join(wide, "k", "left").select(F.col("k.k").alias(key), (n_values + F.col("without")).alias("n_rows"), n_values.alias("n_values"), *names.values())


def heavy_keys(quantiles: DataFrame, key: str = "subject_id", parts: int = 50) -> DataFrame:
    """Of ``key_quantiles``: the non-null keys that hold at least one in ``parts`` of all rows."""
    total = quantiles.agg(F.sum("n_rows")).scalar()
    return quantiles.where(F.col(key).isNotNull() & (F.col("n_rows") * parts >= total))
