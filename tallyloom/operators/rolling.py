"""Look-back windows: every code's history before every index row, over several window sizes.

The window of size W that ends at t holds the events in (t - W, t]. Events of a subject that
share a time and code are first merged to one *partial* (count, value count, sum, sum of squares,
least, greatest); all six aggregations of all windows are then made from partials in one pass.

A subject with a short history of few codes has its index rows joined with its partials: no row meets more
than a few hundred, and everything of a subject is done where it lies. Where histories are long,
that would be quadratic. There, what a code's windows hold changes only where an event comes in or, W later, goes out. So the
aggregations are computed at these *points* alone and hold until the next one.

Histories of many rows are cut into chunks of time no shorter than the longest window. A chunk is given its index times, its partials and those
of the chunk before that reach into it, and, for the full history, one row of older totals for each code: it needs
nothing else, so each row moves once for all windows. Chunks with many rows, or many index rows and codes, are
shared out by code: a subject with a third of all rows is spread over its chunks and codes. In a chunk all
windows are made in numpy (``stretches``), and each stretch leaves with the list of its index times, which is written out as
rows at the very end. Nothing of the size of the result is ever shuffled or sorted.

Which subjects are short is counted first; both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.values import micros, stretch_number
from tallyloom.operators import stretches
from tallyloom.operators.asof import count_until
from tallyloom.schema import ROLLING_AGGS, kind_of, parse_window
from tallyloom.workspace import staged

#: Column of each aggregation, the partial it is made from, and how partials merge.
_PARTS = {
    "code/count": ("code_count", "n", F.sum),
    "value/count": ("value_count", "nv", F.sum),
    "value/sum": ("value_sum", "s", F.sum),
    "value/sum_sqd": ("value_sum_sqd", "ss", F.sum),
    "value/min": ("value_min", "lo", F.min),
    "value/max": ("value_max", "hi", F.max),
}


_MERGES = {"n": F.sum, "nv": F.sum, "s": F.sum, "ss": F.sum, "lo": F.min, "hi": F.max}
#: Histories of at most so many rows, of at most so many codes, are short. With many codes joined rows hardly
#: merge, and the aggregation is as large as the result, which the other way never sorts or shuffles.
_SHORT, _FEW = 256, 16
#: Long histories of more rows are cut into chunks of time no shorter than a year and than the longest window.
_LEAST_CHUNK = 365 * 86_400_000_000
_WHOLE_ROWS = 20_000
#: Windows that hold all the time there is.
_ALL_TIME = 10_000 * 366 * 86_400_000_000
#: The codes of a chunk are shared out so that a group has about so many partials, and so many pairs of index row and code.
_GROUP_ROWS, _GROUP_CELLS = 200_000, 2_000_000
#: Rows of long histories to a task, at most.
_TASK_ROWS = 20_000


def check_rolling(agg: str) -> None:
    kind_of(agg)
    if agg not in _PARTS:
        raise ValueError(f"{agg!r} isn't aggregated over windows")


def collapse_same_time(events: DataFrame, scale: int | None = None) -> DataFrame:
    """One row of partials per subject, time and code: n, nv, s, ss, lo, hi.

    With ``scale``, values count as exact decimals with so many places, and sums don't depend on
    the order of rows; without, as doubles.
    """
    value = F.col("numeric_value") if scale is None else F.col("numeric_value").cast(f"decimal(18,{scale})")
    rows = events.where("subject_id is not null and time is not null and code is not null").select("subject_id", "time", "code", value.alias("v"))
    return rows.groupBy("subject_id", "time", "code").agg(
        F.count("*").alias("n"), F.count("v").alias("nv"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )


def _outputs(aggs: Sequence[str]) -> list[Column]:
    return [F.col(_PARTS[a][0]).cast("long" if a.endswith("count") else "double").alias(_PARTS[a][0]) for a in aggs]


def _chunk(length: int) -> Column:
    """The chunk of ``time``; a subject that isn't cut has one."""
    return F.when(F.col("_cut"), stretch_number(micros(F.col("time")), length)).otherwise(F.lit(0).cast("long"))


def _in_chunks(partials: DataFrame, index: DataFrame, sizes: dict[str, int | None], length: int, need: Sequence[str]) -> DataFrame:
    """The rows that make the windows of each chunk of time, by ``_chunk``: index times, older totals, and partials of the chunk and those that reach into it."""
    key, us = ["subject_id", "code"], micros(F.col("time"))
    index = index.select("subject_id", us.alias("_us"), "_cut", _chunk(length).alias("_chunk"))
    partials = partials.select(*key, us.alias("_us"), *need, "_cut", _chunk(length).alias("_chunk"))
    finite = [s for s in sizes.values() if s is not None]
    reached = F.array("_chunk")
    if finite:
        reaches = F.col("_us") + F.lit(max(finite)).cast("long") > (F.col("_chunk") + 1) * F.lit(length).cast("long")
        reached = F.when(F.col("_cut") & reaches, F.array(F.col("_chunk"), F.col("_chunk") + 1)).otherwise(reached)
    rows = index.drop("_cut").withColumn("_kind", F.lit(stretches.INDEX))
    placed = partials.select(*key, "_us", *need, F.posexplode(reached).alias("_kind", "_chunk")).withColumn("_kind", F.when(F.col("_kind") == 0, stretches.PARTIAL).otherwise(stretches.EARLIER))
    rows = rows.unionByName(placed, allowMissingColumns=True)
    if None in sizes.values():
        # What is older at the start of a chunk is one row for each code, in those chunks alone that have index rows.
        wanted = index.where("_cut").groupBy("subject_id").agg(F.collect_set("_chunk").alias("_wanted"))
        totals = partials.where("_cut").groupBy(*key, "_chunk").agg(*[_MERGES[p](p).alias(p) for p in need]).join(wanted, "subject_id")
        in_order = Window.partitionBy(*key).orderBy("_chunk")
        so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        totals = totals.select(*key, "_chunk", "_wanted", F.lead("_chunk").over(in_order).alias("_next"), *[_MERGES[p](p).over(so_far).alias(p) for p in need])
        until = F.filter("_wanted", lambda c: (c > F.col("_chunk")) & (F.col("_next").isNull() | (c <= F.col("_next"))))
        rows = rows.unionByName(totals.select(*key, *need, F.explode(until).alias("_chunk"), F.lit(stretches.OLDER).alias("_kind")), allowMissingColumns=True)
    # Most partials are of one row, whose value says all: what follows from it isn't moved.
    left_out = ("s", "ss", "hi") if "lo" in need else ()
    return rows.withColumns({p: F.when(F.col("n") > 1, F.col(p)) for p in left_out if p in need})


def _in_groups(rows: DataFrame, partials: DataFrame, index: DataFrame, codes: DataFrame, length: int) -> DataFrame:
    """``rows`` with ``_bucket``: the codes of a subject's chunk are shared out if it has many rows, or many index rows and codes.

    Few chunks are so large: no more than there are rows or cells by the sizes of a group.
    """
    chunk = _chunk(length).alias("_chunk")
    sides = index.select("subject_id", chunk, F.lit(1).alias("_i"), F.lit(0).alias("_p")).unionAll(partials.select("subject_id", chunk, F.lit(0), F.lit(1)))
    sized = sides.groupBy("subject_id", "_chunk").agg(F.sum("_i").alias("_i"), F.sum("_p").alias("_p"))
    before = F.coalesce(F.lag("_p").over(Window.partitionBy("subject_id").orderBy("_chunk")), F.lit(0))
    sized = sized.withColumn("_p", F.col("_p") + before).join(codes, "subject_id")
    shares = F.greatest(F.ceil(F.col("_p") / _GROUP_ROWS), F.ceil(F.col("_i") * F.col("_codes") / _GROUP_CELLS))
    large = sized.select("subject_id", "_chunk", F.least(shares, F.col("_codes")).alias("_shares")).where("_shares > 1")
    rows = rows.join(F.broadcast(large), ["subject_id", "_chunk"], "left")
    every = F.sequence(F.lit(0).cast("long"), F.coalesce("_shares", F.lit(1)) - 1)
    one = F.array(F.pmod(F.xxhash64("code"), F.coalesce("_shares", F.lit(1))))
    return rows.withColumn("_bucket", F.explode(F.when(F.col("_kind") == stretches.INDEX, every).otherwise(one))).drop("_shares")


def rolling_features(
    index: DataFrame, events: DataFrame, windows: Sequence[str] = ("full",), aggs: Sequence[str] = ROLLING_AGGS, scale: int | None = None, partials: DataFrame | None = None
) -> DataFrame:
    """Every window and aggregation for each index row and code with an event in the window.

    Columns: subject_id, time, code, window, and one per aggregation (``code_count``,
    ``value_count``, ``value_sum``, ``value_sum_sqd``, ``value_min``, ``value_max``). A pair of
    index row and code has a row for each window that holds an event of the code; aggregations of
    values are null if none has a value.
    """
    aggs = list(aggs)
    for a in aggs:
        check_rolling(a)
    if not aggs or not windows:
        raise ValueError("no window or aggregation asked for")
    sizes = {w: parse_window(w) for w in windows}
    index = index.select("subject_id", "time").where("subject_id is not null and time is not null").distinct()
    counted = (events if partials is None else partials).groupBy("subject_id", "code").count().groupBy("subject_id").agg(F.sum("count").alias("_rows"), F.count("*").alias("_codes"))
    is_long = (F.col("_rows") > _SHORT) | (F.col("_codes") > _FEW)
    counted = staged(counted.select("subject_id", "_rows", "_codes", is_long.alias("_long")), "sizes")
    in_long, in_all = counted.agg(F.sum(F.when(F.col("_long"), F.col("_rows"))), F.sum("_rows")).first()
    partials = collapse_same_time(events, scale) if partials is None else partials
    if not in_long:
        return _by_pairs(index, partials, sizes, aggs)
    # Both are read by several branches of the plan, so what they come from runs once.
    index, partials = staged(index, "index"), staged(partials, "partials")
    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-in_long // _TASK_ROWS))
    if in_long * 2 > in_all:  # what is short is not worth a plan of its own
        return _by_points(index, partials, sizes, aggs, counted, tasks)
    long = counted.where("_long").select("subject_id")
    short, rest = ([side.join(long, "subject_id", how) for side in (index, partials)] for how in ("left_anti", "left_semi"))
    return _by_pairs(*short, sizes, aggs).unionByName(_by_points(*rest, sizes, aggs, counted, tasks))


def _by_pairs(index: DataFrame, partials: DataFrame, sizes: dict[str, int | None], aggs: Sequence[str]) -> DataFrame:
    """Short histories: each index row against its subject's partials, at most ``_SHORT``, all windows in one aggregation."""
    need = {"n": F.sum, **{_PARTS[a][1]: _PARTS[a][2] for a in aggs}}
    at, us = micros(F.col("_at")), micros(F.col("time"))
    pairs = index.withColumnRenamed("time", "_at").join(partials, "subject_id").where("time <= _at").withColumn("_age", at - us)
    if all(sizes.values()):
        pairs = pairs.where(F.col("_age") < max(sizes.values()))
    merged = [
        merge(F.col(p) if size is None else F.when(F.col("_age") < size, F.col(p))).alias(f"{w}|{p}") for w, size in sizes.items() for p, merge in need.items()
    ]
    rows = pairs.groupBy("subject_id", "_at", "code").agg(*merged)
    cells = [F.struct(F.lit(w).alias("window"), F.col(f"`{w}|n`").alias("_n"), *[F.col(f"`{w}|{_PARTS[a][1]}`").alias(_PARTS[a][0]) for a in aggs]) for w in sizes]
    rows = rows.select("subject_id", F.col("_at").alias("time"), "code", F.explode(F.array(*cells)).alias("_w")).where("_w._n > 0")
    return rows.select("subject_id", "time", "code", "_w.*").select("subject_id", "time", "code", "window", *_outputs(aggs))


def _by_points(index: DataFrame, partials: DataFrame, sizes: dict[str, int | None], aggs: Sequence[str], counted: DataFrame, tasks: int) -> DataFrame:
    """Long histories, by points of change, all windows of a subject's chunk of time in one pass."""
    sizes = {w: None if size is None or size >= _ALL_TIME else size for w, size in sizes.items()}
    length = max([_LEAST_CHUNK, *[s for s in sizes.values() if s is not None]])
    outputs = {_PARTS[a][0]: _PARTS[a][1] for a in aggs}
    need = list(dict.fromkeys(["n", "nv", *outputs.values()]))
    # Cutting a subject costs a row for each code and chunk: only those of many rows are cut, and there are few.
    cut = F.broadcast(counted.where(F.col("_rows") > _WHOLE_ROWS).select("subject_id", F.lit(True).alias("_cut")))
    index, partials = (side.join(cut, "subject_id", "left").withColumn("_cut", F.col("_cut").isNotNull()) for side in (index, partials))
    rows = _in_groups(_in_chunks(partials, index, sizes, length, need), partials, index, counted.select("subject_id", "_codes"), length)
    group = ["subject_id", "_chunk", "_bucket"]
    # By kind, then code, then time: older totals have none and stand before the partials of their code.
    rows = rows.repartition(tasks, *group).sortWithinPartitions(*group, F.col("_kind") != stretches.INDEX, "code", "_us")
    held = rows.mapInArrow(stretches.stretches(sizes, outputs), stretches.output_columns(list(outputs)))
    return held.select("subject_id", F.explode("_at").alias("time"), "code", "window", *outputs)


def rolling_by_spine(index: DataFrame, events: DataFrame, windows: Sequence[str], aggs: Sequence[str] = ROLLING_AGGS, scale: int | None = None) -> DataFrame:
    """The same rows by RANGE frames over one spine per (subject, code): the second plan, for cross-checks and dense histories."""
    aggs = list(aggs)
    index = index.select("subject_id", "time").where("subject_id is not null and time is not null").distinct()
    partials = collapse_same_time(events, scale)
    born = partials.groupBy("subject_id", "code").agg(F.min("time").alias("_born"))
    spine = index.join(born, "subject_id").where("time >= _born").select("subject_id", "time", "code", F.lit(0).alias("_own"))
    both = partials.withColumn("_own", F.lit(1)).unionByName(spine, allowMissingColumns=True).withColumn("_us", micros(F.col("time")))
    out = None
    for w in windows:
        size = parse_window(w)
        low = Window.unboundedPreceding if size is None else -(size - 1)
        frame = Window.partitionBy("subject_id", "code").orderBy("_us").rangeBetween(low, Window.currentRow)
        need = [_PARTS[a][2](_PARTS[a][1]).over(frame).alias(_PARTS[a][0]) for a in aggs]
        rows = both.select("subject_id", "time", "code", "_own", F.sum("n").over(frame).alias("_n"), *need).where("_own = 0 and _n > 0")
        rows = rows.select("subject_id", "time", "code", F.lit(w).alias("window"), *_outputs(aggs))
        out = rows if out is None else out.unionByName(rows)
    return out


def window_bounds(index: DataFrame, window: str) -> DataFrame:
    """The rows of each window as half-open numbers of the subject's index rows: min_index, max_index.

    Numbers run from 0 within each subject, in order of time; the window includes its own row.
    Rows without subject or time are left out. Both ends are counts of earlier rows, made by
    (subject, year), so that no subject is sorted in one task.
    """
    size = parse_window(window)
    rows = index.select("subject_id", "time").where("subject_id is not null and time is not null").distinct()
    out = count_until(rows.withColumn("_at", F.col("time")), rows, "_at", "max_index")
    if size is None:
        return out.select("subject_id", "time", F.lit(0).cast("long").alias("min_index"), "max_index")
    before = out.withColumn("_at", F.timestamp_add("MICROSECOND", F.lit(-size).cast("long"), F.col("time")))
    return count_until(before, rows, "_at", "min_index").select("subject_id", "time", "min_index", "max_index")


def melt(features: DataFrame, aggs: Sequence[str] = ROLLING_AGGS) -> DataFrame:
    """Rolling features as the long feature table: subject_id, time, window, agg, code, value; absent cells have no row."""
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("agg"), F.col(_PARTS[a][0]).cast("double").alias("value")) for a in aggs])).alias("_c")
    return features.select("subject_id", "time", "window", "code", cells).select("subject_id", "time", "window", "_c.agg", "code", "_c.value").where("value is not null")
