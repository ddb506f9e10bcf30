"""Train, validation and test splits that keep related records together.

Related ids are joined to components; components are balanced into many equal bins by largest
differencing; whole bins go to splits by target share.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.skew import hot_keys, skew_lookup
from tallyloom.workspace import scratch_root


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of each Arrow batch as stars around the smallest id of what they join: no more links than ids, and no paths."""
    for pdf in batches:
        root: dict[int, int] = {}
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            ends = []
            for x in (u, v):
                while (up := root.setdefault(x, x)) != x:
                    root[x] = root[up]  # halve the path
                    x = up
                ends.append(x)
            root[max(ends)] = min(ends)
        stars = []
        for x in root:
            top = x
            while root[top] != top:
                top = root[top]
            if top != x:
                stars.append((x, top))
        yield pd.DataFrame(stars, columns=["u", "v"], dtype="int64")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """The connected components of undirected links: id, component (its smallest id), one row per id.

    Repeated and reversed links and links of an id to itself change nothing; links with a null
    are left out. Each batch of links is first contracted by itself. Each round then takes the smallest label among an id's neighbours and its own, gives
    it on to the id's present root, and then jumps to the label's own label, so that rounds grow
    with the logarithm of the longest path. Labels are cut from their lineage by ``checkpoint``;
    links and labels stay distributed, and hubs are looked up by ``skew_lookup``.
    """
    scratch_root(links.sparkSession)
    pairs = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).dropna()
    own = pairs.select("u").union(pairs.select("v")).distinct()
    stars = pairs.where("u <> v").mapInPandas(_contract, "u long, v long").distinct().checkpoint()
    edges = stars.union(stars.select("v", "u"))
    labels = own.select(F.col("u").alias("id"), F.col("u").alias("component")).checkpoint()
    hubs = hot_keys(edges, "v")
    while True:
        seen = skew_lookup(edges, "v", labels, "id", [F.col("component").alias("_c")], hubs)
        nearest = seen.groupBy("u").agg(F.min("_c").alias("_m"))
        told = labels.join(nearest.withColumnRenamed("u", "id"), "id", "left").withColumn("_m", F.least("component", "_m"))
        # What a member learns, its root learns too.
        roots = told.groupBy("component").agg(F.min("_m").alias("_r")).select(F.col("component").alias("id"), "_r")
        new = told.join(roots, "id", "left").select("id", F.col("component").alias("was"), F.least("_m", "_r").alias("label")).checkpoint()
        jumped = skew_lookup(new, "label", new, "id", [F.col("label").alias("_j")])
        state = jumped.select("id", "was", F.least("label", "_j").alias("component")).checkpoint()
        labels = state.select("id", "component")
        if state.where("was <> component").isEmpty():
            return labels


def largest_differencing(weights: Sequence[float], bins: int) -> np.ndarray:
    """The bin of each item: repeatedly the two most uneven partial solutions are combined, opposed.

    A partial solution is a vector of ``bins`` sums. The two with the widest spread are merged so
    that the fullest bins of one meet the emptiest of the other.
    """
    n = len(weights)
    if not n:
        return np.array([], dtype=np.int64)
    sums: dict[int, np.ndarray] = {}
    heap = []
    order = np.argsort(-np.asarray(weights, dtype=float), kind="stable")
    for i in order:
        vector = np.zeros(bins)
        vector[0] = weights[i]
        sums[int(i)] = vector
        heap.append((-float(weights[i]), int(i)))
    return _combine(sums, heap, n, bins, [np.zeros(1, dtype=np.int64)] * n)


def _combine(sums: dict[int, np.ndarray], heap: list, n: int, bins: int, slots: list[np.ndarray]) -> np.ndarray:
    """Final bins of the used slots of all ``n`` starting solutions, joined in order."""
    heapq.heapify(heap)
    parents: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    new = n
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        x, y = sums.pop(a), sums.pop(b)
        down, up = np.argsort(-x, kind="stable"), np.argsort(y, kind="stable")
        merged = x[down] + y[up]
        # place[k]: where slot k of a child lies in the merged solution.
        place_x, place_y = np.empty(bins, dtype=np.int32), np.empty(bins, dtype=np.int32)
        place_x[down] = np.arange(bins, dtype=np.int32)
        place_y[up] = np.arange(bins, dtype=np.int32)
        parents.append((a, b, place_x, place_y))
        sums[new] = merged
        heapq.heappush(heap, (-(merged.max() - merged.min()), new))
        new += 1
    final: dict[int, np.ndarray] = {heap[0][1]: np.arange(bins, dtype=np.int32)}
    for k in range(len(parents) - 1, -1, -1):
        a, b, place_x, place_y = parents[k]
        here = final.pop(n + k)
        final[a], final[b] = here[place_x], here[place_y]
    return np.concatenate([final[i][slots[i]] for i in range(n)]).astype(np.int64)


def balance(items: DataFrame, key: str, weight: str, bins: int = 100, per_task: int = 20_000, fan_in: int = 200) -> DataFrame:
    """Items in ``bins`` nearly equal bins: key, weight, bin (0 to bins - 1), by largest differencing.

    Items are spread by hash into groups of about ``per_task``, each balanced in a task; the
    groups' solutions, ``bins`` sums each, are then merged by the same rule, ``fan_in`` at a time,
    until one is left. No task sees more than ``per_task`` items or ``fan_in`` x ``bins`` sums.
    """
    groups = max(1, -(-items.count() // per_task))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", ignore_index=True)
        pdf["slot"] = largest_differencing(pdf["weight"].to_numpy(), bins)
        return pdf[["item", "weight", "grp", "slot"]]

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["grp", "slot"], ignore_index=True)
        ids = sorted(pdf["grp"].unique())
        sums, heap, slots = {}, [], []
        for i, g in enumerate(ids):
            vector = np.zeros(bins)
            part = pdf[pdf["grp"] == g]
            vector[part["slot"].to_numpy()] = part["weight"].to_numpy()
            sums[i] = vector
            slots.append(np.arange(bins))
            heap.append((-(vector.max() - vector.min()), i))
        to = _combine(sums, heap, len(ids), bins, slots)
        return pd.DataFrame({"grp": np.repeat(ids, bins), "slot": np.tile(np.arange(bins), len(ids)), "grp2": pdf["grp2"].iloc[0], "slot2": to})

    sized = items.select(F.col(key).alias("item"), F.col(weight).cast("double").alias("weight")).withColumn("grp", F.pmod(F.xxhash64("item"), F.lit(groups)))
    placed = sized.groupBy("grp").applyInPandas(first, f"item {items.schema[key].dataType.simpleString()}, weight double, grp long, slot long").checkpoint()
    while groups > 1:
        sums = placed.groupBy("grp", "slot").agg(F.sum("weight").alias("weight")).withColumn("grp2", F.floor(F.col("grp") / fan_in))
        moves = sums.groupBy("grp2").applyInPandas(merge, "grp long, slot long, grp2 long, slot2 long")
        placed = placed.join(moves, ["grp", "slot"]).select("item", "weight", F.col("grp2").alias("grp"), F.col("slot2").alias("slot")).checkpoint()
        groups = -(-groups // fan_in)
    return placed.select(F.col("item").alias(key), F.col("weight").alias(weight), F.col("slot").alias("bin"))


def allocate(sums: Sequence[tuple[int, float]], targets: dict[str, float]) -> dict[int, str]:
    """Whole bins to splits: the fullest bins first, each to the split furthest below its target."""
    total, share = sum(w for _, w in sums), sum(targets.values())
    lacking = {s: t / share * total for s, t in sorted(targets.items())}
    places = {s: t / share * len(sums) for s, t in lacking.items()} if total else {}
    out = {}
    for number, w in sorted(sums, key=lambda x: (-x[1], x[0])):
        split = max(lacking, key=lambda s: (lacking[s], places.get(s, 0)))
        out[number] = split
        lacking[split] -= w
    return out


def grouped_splits(ids: DataFrame, links: DataFrame, targets: DataFrame, current: DataFrame | None = None, bins: int = 100) -> DataFrame:
    """A split for every id such that all ids of one component share it.

    ``ids``: (id, weight) with the records of each id, repeated ids add up; ``links``: (a, b);
    ``targets``: (split, share), a handful of rows, read by the driver; ``current``: (id, split),
    an assignment to audit, may repeat and contradict itself. Every id of any of the tables gets
    a row: id, component, weight, bin, split, n_current and n_assigned (how many splits its
    component has in ``current`` and in the new assignment), in_current (whether the id itself is
    there). Components torn apart by ``current`` have n_current > 1; n_assigned is 1. Null ids and null current splits are left out; ids without
    links are components of their own; ids of weight 0 are spread evenly. Empty tables give no rows.

    Balancing sees components only as weights, see ``balance``; the driver sees ``bins`` sums.
    """
    spark = ids.sparkSession
    scratch_root(spark)
    weights = ids.select(F.col(ids.columns[0]).cast("long").alias("id"), F.col(ids.columns[1]).cast("double").alias("weight")).where("id is not null")
    joined = components(links, *links.columns[:2])
    if current is None:
        current = spark.createDataFrame([], "id long, split string")
    current = current.select(F.col(current.columns[0]).cast("long").alias("id"), F.col(current.columns[1]).alias("current")).dropna().distinct()
    every = weights.unionByName(joined.select("id", F.lit(0.0).alias("weight"))).unionByName(current.select("id", F.lit(0.0).alias("weight")))
    nodes = every.groupBy("id").agg(F.sum("weight").alias("weight")).join(joined, "id", "left")
    nodes = nodes.withColumn("component", F.coalesce("component", "id")).checkpoint()
    persons = nodes.groupBy("component").agg(F.sum("weight").alias("total"), F.count("*").alias("members"))
    # Ids without records weigh a trifle, so that they too are shared out in proportion.
    trifle = 1e-6
    placed = balance(persons.withColumn("load", F.col("total") + trifle * F.col("members")), "component", "load", bins)
    sums = [(r["bin"], r["w"]) for r in placed.groupBy("bin").agg(F.sum("load").alias("w")).collect()]
    split_of = allocate(sums, {r[0]: float(r[1]) for r in targets.select(*targets.columns[:2]).dropna().collect()})
    table = spark.createDataFrame(list(split_of.items()), "bin long, split string")
    placed = placed.join(F.broadcast(table), "bin").select("component", "bin", "split")
    assigned = skew_lookup(nodes, "component", placed, "component", ["bin", "split"]).checkpoint()
    # Both assignments are audited together, by the components that were balanced.
    audit = assigned.join(current, "id", "left").groupBy("component")
    audit = audit.agg(F.size(F.collect_set("current")).alias("n_current"), F.size(F.collect_set("split")).alias("n_assigned"))
    present = current.select("id").distinct().withColumn("in_current", F.lit(True))
    out = skew_lookup(assigned, "component", audit, "component", ["n_current", "n_assigned"])
    return out.join(present, "id", "left").select("id", "component", "weight", "bin", "split", "n_current", "n_assigned", F.coalesce("in_current", F.lit(False)).alias("in_current"))
