"""Pairs of records from two tables that are nearest in time, as a stateful streaming join.

Both sides flow as one log through Structured Streaming. State is kept per *bucket*: a hash of
(entity, stretch of time), so that an entity with a third of all rows is spread over as many
buckets as it has stretches. A bucket buffers both sides per entity; a left row is emitted once
the watermark has passed its time plus the tolerance, when nothing nearer can come; right rows
are evicted once no left row, waiting or to come, can reach them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.values import micros
from tallyloom.workspace import scratch_path, staged

#: Rows of the log: side 0 left, 1 right, 2 a mark that only moves the watermark.
LOG = "side int, entity long, stretch long, t long, id long, event_time timestamp"
_COLUMNS = ["side", "entity", "stretch", "t", "id"]
_OUT = "left_id long, left_t long, right_id long, right_t long"
DAY = 86_400_000_000
#: The stream's clock runs slower than the data's by this factor, so that centuries stay within the range of any timestamp type.
CLOCK = 1000


def nearest_pairs(rows: pd.DataFrame, tolerance: int) -> pd.DataFrame:
    """For each left row (side 0) the nearest right row of its entity and stretch, if near enough.

    Of two equally near times the earlier wins, of rows at one time the smallest id.
    """
    if not len(rows):
        return pd.DataFrame({c: np.array([], dtype=np.int64) for c in ("left_id", "left_t", "right_id", "right_t")})
    entity = pd.factorize(pd.MultiIndex.from_frame(rows[["entity", "stretch"]]))[0]
    side, t, ids = (rows[c].to_numpy() for c in ("side", "t", "id"))
    # Right rows come before left rows of their time, the one with the greatest id first.
    order = np.lexsort((np.where(side == 1, -ids, ids), side == 0, t, entity))
    entity, side, t, ids = entity[order], side[order], t[order], ids[order]
    n = len(t)
    at = np.arange(n)
    before = np.maximum.accumulate(np.where(side == 1, at, -1))
    after = np.minimum.accumulate(np.where(side == 1, at, n)[::-1])[::-1]
    # The first of a run of equal times, seen from the front, has its greatest id: step to the run's last row.
    run = np.flatnonzero(np.r_[True, (entity[1:] != entity[:-1]) | (t[1:] != t[:-1]) | (side[1:] != side[:-1])])
    last_of = np.r_[run[1:], n] - 1
    last = last_of[np.searchsorted(run, at, side="right") - 1]
    left = np.flatnonzero(side == 0)
    p, q = before[left], after[left]
    far = np.iinfo(np.int64).max
    q_last = last[np.minimum(q, n - 1)]
    d_p = np.where((p >= 0) & (entity[p] == entity[left]), t[left] - t[p], far)
    d_q = np.where((q < n) & (entity[q_last] == entity[left]), t[q_last] - t[left], far)
    pick = np.where(d_p <= d_q, p, q_last)
    ok = np.minimum(d_p, d_q) <= tolerance
    left, pick = left[ok], pick[ok]
    return pd.DataFrame({"left_id": ids[left], "left_t": t[left], "right_id": ids[pick], "right_t": t[pick]})


def nearest_stream(log: DataFrame, tolerance: int, shift: int, buckets: int) -> DataFrame:
    """The streaming operator: a log (``LOG``) with watermark -> (left_id, left_t, right_id, right_t).

    ``log`` is a streaming DataFrame; ``event_time`` is t minus ``shift``, in units of ``CLOCK`` microseconds.
    A row must not be later than the watermark's delay allows, as with every streaming join.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = [pickle.loads(state.get[0])] if state.exists else []
        if not state.hasTimedOut:
            held += [b[_COLUMNS] for b in batches]
        rows = pd.concat(held, ignore_index=True) if held else pd.DataFrame({c: np.array([], dtype=np.int64) for c in _COLUMNS})
        watermark = state.getCurrentWatermarkMs() * 1000 * CLOCK + shift
        left = rows["side"] == 0
        ready = left & (rows["t"] + tolerance < watermark)
        out = nearest_pairs(rows[ready | (rows["side"] == 1)], tolerance)
        waiting = left & ~ready
        # The earliest left row that may still ask: one that waits or one yet to come.
        earliest = min(watermark, rows.loc[waiting, "t"].min()) if waiting.any() else watermark
        keep = rows[waiting | ((rows["side"] == 1) & (rows["t"] >= earliest - tolerance))]
        if len(keep):
            state.update((pickle.dumps(keep.reset_index(drop=True), protocol=5),))
            # Wake up when the first waiting row passes its horizon, or else to forget the last right row.
            first = rows.loc[waiting, "t"].min() if waiting.any() else keep["t"].max()
            due = int(first + tolerance - shift) // (1000 * CLOCK) + 2
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if len(out):
            yield out

    keyed = log.withColumn("bucket", F.pmod(F.xxhash64("entity", "stretch"), F.lit(buckets)))
    return keyed.groupBy("bucket").applyInPandasWithState(step, _OUT, "rows binary", "append", "EventTimeTimeout")


def _part(number: str, length: int):
    """The number of the stretch of ``length`` in which a whole number lies, in whole-number arithmetic."""
    return F.expr(f"({number} - pmod({number}, {length})) div {length}")


def _move(spark: SparkSession, source: str, target: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(target).getParent())
    if fs.exists(path(source)) and not fs.rename(path(source), path(target)):
        raise OSError(f"can't move {source}")


def _cut_crowded(near: DataFrame, asks: DataFrame, stretch: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with their ``place`` in a stretch: 0, or where an entity has more than ``most`` right rows in it, one of several."""
    key = ["entity", "stretch"]
    many = near.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > most)
    many = staged(many.select(*key, F.greatest(F.lit(1), F.expr(f"{stretch} div ceil(2 * n / {most})")).cast("long").alias("length")), "crowded")
    if many.isEmpty():
        return near.withColumn("place", F.lit(0)), asks.withColumn("place", F.lit(0))
    # The few crowded stretches hold any number of rows: they meet by a broadcast if the list is short, else AQE parts what is skewed.
    inside = F.expr(f"greatest(least(t - stretch * {stretch}, {stretch - 1}), 0)")
    place = F.when(F.col("length").isNotNull(), F.floor(inside / F.col("length")).cast("long")).otherwise(0).alias("place")
    near, asks = (side.join(many, key, "left").select("entity", "t", "id", "stretch", place, F.col("length").isNotNull().alias("cut")) for side in (near, asks))
    ends = near.where("cut").groupBy(*key, "place").agg(F.min(F.struct("t", "id")).alias("first"), F.max(F.struct("t", "id")).alias("last"))
    all_places = ends.unionByName(asks.where("cut").select(*key, "place").distinct(), allowMissingColumns=True).groupBy(*key, "place")
    # A stretch has no more places than it has times ``most`` rows, and twice that.
    order = Window.partitionBy(*key).orderBy("place")
    before = F.last("last", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("first", True).over(order.rowsBetween(1, Window.unboundedFollowing))
    lent = all_places.agg(F.min("first").alias("first"), F.max("last").alias("last")).select(*key, "place", F.array(before, after).alias("both"))
    lent = lent.select(*key, "place", F.explode("both").alias("r")).where("r is not null")
    return near.drop("cut").unionByName(lent.select("entity", "r.t", "r.id", "stretch", "place")), asks.drop("cut")


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    tolerance: int = 6 * 3600 * 1_000_000,
    left_id: str = "label_id",
    left_entity: str = "subject_id",
    left_time: str = "prediction_time",
    right_id: str = "obs_id",
    right_entity: str = "subject_id",
    right_time: str = "time",
    stretch: int | None = None,
    rows_per_slice: int | None = None,
    rows_per_bucket: int = 20_000,
    rows_per_place: int = 100_000,
) -> DataFrame:
    """Each left row with the right row of its entity nearest in time, at most ``tolerance`` microseconds off.

    Columns: left_id, right_id, distance (microseconds, negative if the right row is earlier).
    Left rows without a candidate give no row. The nearest time wins, of two equally near times
    the earlier, of right rows at that time the smallest id. Rows with a null entity, time or id
    take no part; repeated left ids give one row; empty tables give an empty result; columns
    other than those named are dropped, whatever they are called.

    ``stretch``, eight tolerances unless given, is the length of time that shares a bucket: the
    rows of an entity are spread over as many buckets as it has stretches, and a left row near
    the border of two asks in both. Of right rows of an entity at one time only the one with the
    smallest id can win, and only it goes on. Where an entity still has more than
    ``rows_per_place`` rows in a stretch, as a sensor may, that stretch is cut into equal places,
    each of which also gets the right row before its first and the one after its last, so that a
    left row asks in one place of a stretch only.

    Stored tables are replayed through the streaming join in order of time: right rows that no
    left row can reach are first removed by a semi-join on (entity, stretch of half a tolerance);
    the rest is written as a log of time slices of about ``rows_per_slice`` rows (a million for
    each shuffle partition unless given), and each slice is given to the stream as new files,
    with the state and watermark of the slices before it. So no row is ever late, and state holds
    one slice and what is within a tolerance of it, however long the log. A last mark moves the
    watermark past every horizon.
    """
    spark = left.sparkSession
    stretch = 8 * tolerance + 1 if stretch is None else stretch
    if stretch < 2 * tolerance:
        raise ValueError("a stretch must be longer than two tolerances")
    lefts = left.select(F.col(left_id).cast("long").alias("id"), F.col(left_entity).cast("long").alias("entity"), micros(F.col(left_time)).alias("t")).dropna()
    rights = right.select(F.col(right_id).cast("long").alias("id"), F.col(right_entity).cast("long").alias("entity"), micros(F.col(right_time)).alias("t")).dropna()
    lefts = staged(lefts, "left")
    bounds = lefts.agg(F.min("t"), F.max("t")).first()
    if bounds[0] is None:
        return spark.createDataFrame([], "left_id long, right_id long, distance long")

    def places(length: int):
        return F.explode(F.sequence(_part(f"t - {tolerance}", length), _part(f"t + {tolerance}", length)))

    cell = tolerance // 2 + 1
    reachable = lefts.select("entity", places(cell).alias("cell")).distinct()
    near = rights.where(F.col("t").between(bounds[0] - tolerance, bounds[1] + tolerance)).withColumn("cell", _part("t", cell))
    near = near.join(reachable, ["entity", "cell"], "left_semi").groupBy("entity", "t").agg(F.min("id").alias("id"))
    near = staged(near.select("entity", "t", "id", _part("t", stretch).alias("stretch")), "near")
    asks = lefts.select("entity", "t", "id", places(stretch).alias("stretch"))
    near, asks = _cut_crowded(near, asks, stretch, rows_per_place)
    # Should two places of an entity share a hash, each sees right rows of the other, which are real ones and as far off as they are.
    place = F.xxhash64("stretch", "place").alias("stretch")
    log = asks.select(F.lit(0).alias("side"), "entity", place, "t", "id").unionByName(near.select(F.lit(1).alias("side"), "entity", place, "t", "id"))
    shift = bounds[0] - tolerance - DAY
    base = scratch_path(spark, "nearest")
    times = near.select("t").unionByName(lefts.select("t"))
    rows = times.count()
    rows_per_slice = rows_per_slice or 1_000_000 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = max(1, -(-rows // rows_per_slice))
    cuts = sorted(set(times.approxQuantile("t", [i / slices for i in range(1, slices)], 0.1 / slices))) if slices > 1 else []
    number = sum([(F.col("t") >= int(c)).cast("int") for c in cuts], F.lit(0))
    log = log.withColumn("event_time", F.timestamp_micros(_part(f"t - ({shift})", CLOCK)))
    log.withColumn("slice", number).write.partitionBy("slice").parquet(f"{base}/staged")
    end = bounds[1] + 2 * tolerance + DAY  # the clock's millisecond is a second of the data
    mark = spark.range(1).select(
        F.lit(2).alias("side"), F.lit(0).cast("long").alias("entity"), F.lit(0).cast("long").alias("stretch"), F.lit(end).cast("long").alias("t"), F.lit(0).cast("long").alias("id"),
        F.timestamp_micros(F.lit((end - shift) // CLOCK).cast("long")).alias("event_time"),
    )
    mark.write.parquet(f"{base}/staged-end")

    for i in range(len(cuts) + 2):
        _move(spark, f"{base}/staged/slice={i}" if i <= len(cuts) else f"{base}/staged-end", f"{base}/log/s{i:03}")
        source = spark.readStream.schema(LOG).option("recursiveFileLookup", True).parquet(f"{base}/log").withWatermark("event_time", "1 millisecond")
        query = (
            nearest_stream(source, tolerance, shift, max(16, rows // rows_per_bucket))
            .writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
            .outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    found = spark.read.schema(_OUT).parquet(f"{base}/out")
    offset = F.col("right_t") - F.col("left_t")
    best = found.groupBy("left_id").agg(F.min(F.struct(F.abs(offset).alias("a"), F.col("right_t").alias("t"), F.col("right_id").alias("i"), offset.alias("d"))).alias("b"))
    return best.select("left_id", F.col("b.i").alias("right_id"), F.col("b.d").alias("distance"))
