import datetime as dt
import random
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallyloom.functions.values import live_rows
from tallyloom.operators import trailing

KEYS = ["subject_id", "code"]
SCHEMA = "subject_id long, code string, time timestamp_ntz, numeric_value double"
DAY0 = dt.datetime(1999, 12, 20)


def brute(rows, windows=(7, 30)):
    days = defaultdict(lambda: defaultdict(lambda: [0, 0]))
    for s, c, t, v in rows:
        if None not in (s, c, t, v):
            cell = days[s, c][t.date()]
            cell[0] += round(v * 10)
            cell[1] += 1
    out = {}
    for key, by_day in days.items():
        day, last = min(by_day), max(by_day)
        while day <= last:
            out[(*key, day)] = tuple(
                sum(by_day[d][i] for d in (day - dt.timedelta(n) for n in range(w)) if d in by_day) for i in (0, 1) for w in windows
            )
            day += dt.timedelta(1)
    return out


def found(df, windows=(7, 30)):
    return {(r.subject_id, r.code, r.day): tuple(r[f"units_{w}"] for w in windows) + tuple(r[f"n_{w}"] for w in windows) for r in df.collect()}


def random_rows(seed, n=60, span=400):
    rng = random.Random(seed)
    return [(rng.choice([1, 2, None]), rng.choice(["A", "B"]), DAY0 + dt.timedelta(hours=rng.randrange(span * 24)), rng.choice([None, 0.0, -2.5, 1.1, 7.0])) for _ in range(n)]


@pytest.mark.parametrize("shard_days", [2, 8, 64])
def test_against_brute_force(spark, shard_days):
    rows = random_rows(shard_days)
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(trailing.trailing_totals(df, shard_days=shard_days)) == brute(rows)


def test_far_past_and_wide_windows(spark):
    rows = [(1, "A", dt.datetime(1931, 1, 1), 1.5), (1, "A", dt.datetime(1931, 7, 1, 23, 59), 2.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(trailing.trailing_totals(df, windows=(1, 100), shard_days=16), (1, 100)) == brute(rows, (1, 100))


def test_cover_is_exact_and_short():
    for lo in range(16):
        for hi in range(lo, 16):
            nodes = trailing._cover(lo, hi, 16)
            days = []
            for n in nodes:
                width = 16 >> (n.bit_length() - 1)
                start = (n - (1 << (n.bit_length() - 1))) * width
                days += range(start, start + width)
            assert sorted(days) == list(range(lo, hi + 1)) and len(nodes) <= 2 * 4


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_corrections_equal_rebuilding(spark, seed):
    rows = random_rows(seed, 30, 90)
    df = spark.createDataFrame(rows, SCHEMA)
    cut = len(rows) // 2
    old, new = (trailing.daily_leaves(spark.createDataFrame(r, SCHEMA), KEYS, "time", "numeric_value") for r in (rows[:cut], rows[cut:]))
    trees = trailing.correct_trees(trailing.build_trees(old, KEYS, 16), new, KEYS, 16)
    assert found(trailing.query_trees(trees, KEYS, shard_days=16)) == found(trailing.trailing_totals(df, shard_days=16))
    fresh = {(r.subject_id, r.code, r.shard): list(r.totals) for r in trailing.build_trees(trailing.daily_leaves(df, KEYS, "time", "numeric_value"), KEYS, 16).collect()}
    assert {(r.subject_id, r.code, r.shard): list(r.totals) for r in trees.collect()} == fresh


def test_a_correction_may_empty_a_series(spark):
    rows = [(1, "A", DAY0, 1.0), (1, "A", DAY0 + dt.timedelta(3), 2.0)]
    leaves = trailing.daily_leaves(spark.createDataFrame(rows, SCHEMA), KEYS, "time", "numeric_value")
    away = trailing.daily_leaves(spark.createDataFrame(rows[1:], SCHEMA), KEYS, "time", "numeric_value").selectExpr("subject_id", "code", "day", "-total as total", "-n as n")
    got = trailing.query_trees(trailing.correct_trees(trailing.build_trees(leaves, KEYS), away, KEYS), KEYS)
    assert found(got) == brute(rows[:1])


def test_empty_nulls_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trailing.trailing_totals(empty).count() == 0
    rows = [(1, "A", DAY0, 1.0), (None, "A", DAY0, 1.0), (1, None, DAY0, 1.0), (1, "A", None, 1.0), (1, "A", DAY0, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as day", "'x' as shard", "2 as total", "3 as n", "4 as _lo")
    assert found(trailing.trailing_totals(df)) == brute(rows)


def test_windows_must_be_days(spark):
    with pytest.raises(ValueError):
        trailing.trailing_totals(spark.createDataFrame([], SCHEMA), windows=(0,))
    with pytest.raises(ValueError):
        trailing.trailing_totals(spark.createDataFrame([], SCHEMA), shard_days=60)


def test_live_rows(spark):
    nan = float("nan")
    rows = [(1, " a\t", DAY0, nan), (1, "A\n", DAY0, None), (1, "A", None, 0.0), (1, "a", None, -0.0), (None, "A", DAY0, 1.0), (1, None, DAY0, 1.0)]
    got = live_rows(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "7 as value", "8 as units")).collect()
    assert sorted((r.subject_id, r.code, r.time is None, r.numeric_value) for r in got) == [(1, "A", False, None), (1, "A", True, 0.0)]


def test_bursts_are_strict(spark):
    # 12 * T7 > 7 * T30 fails on equality.
    base = [(1, "A", DAY0, 10.0)] + [(1, "A", DAY0 + dt.timedelta(29), v) for v in (14.0,)]
    got = trailing.bursts(trailing.trailing_totals(spark.createDataFrame(base, SCHEMA))).count()
    assert got == int(12 * 14.0 > 7 * 24.0) == 0
    assert trailing.bursts(trailing.trailing_totals(spark.createDataFrame([(*base[0],), (1, "A", DAY0 + dt.timedelta(29), 14.1)], SCHEMA))).count() == 1
