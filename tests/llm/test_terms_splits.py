import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import splits, terms


def test_terms(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (3, "a"), (4, "a"), (5, "a")] + [(1, "b")] * 12 + [(s, "c") for s in (1, 2, 3) for _ in range(4)] + [(None, "a"), (1, None)]
    df = spark.createDataFrame(rows, "subject_id long, code string").selectExpr("*", "1 as n", "2 as term", "3 as record")
    got = {r.term: (r.n, r.n_records, r.mark) for r in terms.term_frequencies(df, "subject_id", "code", 5, min_count=6).collect()}
    assert got == {"a": (6, 5, "common"), "b": (12, 1, "rare"), "c": (12, 3, None)}
    assert terms.term_frequencies(df.limit(0), "subject_id", "code", 0).count() == 0


def test_terms_of_rows_sent_twice(spark):
    """Repeated rows count once, whether their record is hot or not."""
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4, None]), rng.choice([" a", "A ", "b", "c", None]), rng.randrange(6), rng.choice([0.5, None, float("nan")])) for _ in range(400)]
    df = spark.createDataFrame(rows, "subject_id long, code string, t long, numeric_value double").selectExpr("*", "timestamp_seconds(t) as time", "1 as n")
    live = {(s, c.strip().upper(), t, v if v == v else None) for s, c, t, v in rows if s is not None and c is not None}
    want = {c: (len([x for x in live if x[1] == c]), len({x[0] for x in live if x[1] == c})) for c in "ABC"}
    for hot in ([], [1], [1, 2, 3, 4]):
        got = terms.distinct_term_counts(df.drop("t"), "subject_id", "code", ["time", "numeric_value"], hot)
        assert {r.term: (r.n, r.n_records) for r in terms.marked(got, 4).collect()} == want


def brute_components(links):
    peer = {}

    def root(x):
        while peer.setdefault(x, x) != x:
            x = peer[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            x, y = sorted((root(a), root(b)))
            peer[y] = x
    return {x: root(x) for x in list(peer)}


def test_components(spark):
    rng = random.Random(4)
    path = [(i, i + 1) for i in range(100, 160)]
    rng.shuffle(path)
    star = [(1000 + i, 999) for i in range(50)]
    links = path + star + [(b, a) for a, b in path[:20]] + star[:5] + [(7, 7), (None, 3), (4, None), (5, 6), (160, 90)] + [(rng.randrange(2000, 2040), rng.randrange(2000, 2040)) for _ in range(25)]
    df = spark.createDataFrame(links, "a long, b long").selectExpr("a", "b", "1 as id", "2 as component")
    for batch in ("10000", "7"):  # one batch joins all, and many that only rounds can join
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = {r.id: r.component for r in splits.components(df, "a", "b").collect()}
        assert got == brute_components(links)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert splits.components(df.limit(0), "a", "b").count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 1000), max_size=60), st.integers(1, 8))
def test_differencing_uses_each_item_once(weights, bins):
    got = splits.largest_differencing(weights, bins)
    assert len(got) == len(weights) and all(0 <= b < bins for b in got)


def test_differencing_balances():
    rng = np.random.default_rng(1)
    w = rng.integers(1, 500, 3000)
    sums = np.bincount(splits.largest_differencing(w, 20), weights=w, minlength=20)
    assert sums.max() - sums.min() <= 2
    # The textbook case of two bins: 8 7 6 5 4 differ by 2 after differencing.
    sums = np.bincount(splits.largest_differencing([8, 7, 6, 5, 4], 2), weights=[8, 7, 6, 5, 4])
    assert abs(sums[0] - sums[1]) == 2


def test_balance_in_many_groups(spark):
    rng = random.Random(2)
    items = [(i, float(rng.randrange(1, 300))) for i in range(2000)]
    got = splits.balance(spark.createDataFrame(items, "k long, w double"), "k", "w", bins=10, per_task=150, fan_in=4).collect()
    assert sorted((r.k, r.w) for r in got) == items
    sums = Counter()
    for r in got:
        sums[r.bin] += r.w
    assert len(sums) == 10 and max(sums.values()) - min(sums.values()) < 0.01 * sum(sums.values()) / 10


def test_grouped_splits(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(0, 60, 3)] + [(600, 601), (None, 5)]
    ids = [(i, rng.randrange(1, 40)) for i in range(400)] + [(None, 99), (3, 10)]
    current = [(i, rng.choice(["train", "tuning"])) for i in range(200)] + [(5, None), (700, "train"), (2, "tuning"), (2, "train")]
    out = splits.grouped_splits(
        spark.createDataFrame(ids, "s long, n long"), spark.createDataFrame(links, "a long, b long"),
        spark.createDataFrame([("train", 0.7), ("tuning", 0.15), ("held_out", 0.15)], "split_name string, share double"), spark.createDataFrame(current, "s long, x string"),
    ).collect()
    joined = brute_components(links)
    assert sorted(r.id for r in out) == sorted({i for i, _ in ids if i is not None} | set(joined) | {700})
    by = defaultdict(set)
    for r in out:
        assert r.component == joined.get(r.id, r.id)
        by[r.component].add(r.split)
    assert all(len(s) == 1 for s in by.values())
    share = Counter()
    for r in out:
        share[r.split] += r.weight
    total = sum(share.values())
    assert share["train"] / total == pytest.approx(0.7, abs=0.02) and share["tuning"] / total == pytest.approx(0.15, abs=0.02)
    now = defaultdict(set)
    for i, s in current:
        if s is not None:
            now[joined.get(i, i)].add(s)
    assert {r.n_assigned for r in out} == {1}
    assert {r.id: r.n_current for r in out} == {r.id: len(now[r.component]) for r in out}
    assert {r.id for r in out if r.in_current} == {i for i, s in current if s is not None}


def test_splits_without_broadcasts(spark):
    """Where tables are over the planner's limit, joins are by shuffle: only the table of bins is broadcast."""
    links = [(i, i + 1) for i in range(0, 90, 3)] + [(200 + i, 200) for i in range(1, 30)]
    tables = [
        spark.createDataFrame([(i, i % 7 + 1) for i in range(300)], "s long, n long"), spark.createDataFrame(links, "a long, b long"),
        spark.createDataFrame([("train", 0.7), ("tuning", 0.3)], "split_name string, share double"), spark.createDataFrame([(i, "train") for i in range(100)] + [(1, "tuning")], "s long, x string"),
    ]
    rows = sorted(tuple(r) for r in splits.grouped_splits(*tables).collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        out = splits.grouped_splits(*tables)
        assert sorted(tuple(r) for r in out.collect()) == rows
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().toString() and "SortMergeJoin" in out._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_without_balancing_no_person_counts_as_kept(spark, monkeypatch):
    monkeypatch.setattr(splits, "allocate", lambda sums, targets: {b: None for b, _ in sums})
    out = splits.grouped_splits(
        spark.createDataFrame([(1, 1), (2, 1)], "s long, n long"), spark.createDataFrame([(1, 2)], "a long, b long"), spark.createDataFrame([("train", 1.0)], "split_name string, share double"),
        spark.createDataFrame([(1, "train"), (2, "tuning")], "s long, x string"),
    )
    assert {(r.n_current, r.n_assigned) for r in out.collect()} == {(2, 0)}


def test_grouped_splits_of_nothing(spark):
    empty = spark.createDataFrame([], "a long, b long")
    targets = spark.createDataFrame([("train", 1.0)], "split_name string, share double")
    assert splits.grouped_splits(empty, empty, targets).count() == 0
