import datetime as dt
import random

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm.nearest import nearest_in_time, nearest_pairs

T = dt.datetime(2010, 1, 1)
US = dt.timedelta(microseconds=1)
TOL = 6 * 3600 * 1_000_000


def brute(left, right, tol):
    out = {}
    for i, s, t in left:
        if s is None or t is None or i is None:
            continue
        near = [(abs((u - t) // US), u, j, (u - t) // US) for j, k, u in right if k == s and u is not None and j is not None and abs((u - t) // US) <= tol]
        if near:
            d = min(near)
            out[i] = (d[2], d[3])
    return out


ROW = st.tuples(st.sampled_from([1, 2]), st.integers(0, 60))


@settings(max_examples=200, deadline=None)
@given(st.lists(ROW, max_size=12), st.lists(ROW, max_size=25), st.integers(1, 15))
def test_pairs_of_a_batch(left, right, tol):
    rows = [(0, s, 0, t, i) for i, (s, t) in enumerate(left)] + [(1, s, 0, t, i) for i, (s, t) in enumerate(right)]
    random.Random(len(rows)).shuffle(rows)
    got = nearest_pairs(pd.DataFrame(rows, columns=["side", "entity", "stretch", "t", "id"]), tol)
    at = lambda x: [(i, s, T + t * US) for i, (s, t) in enumerate(x)]
    assert {r.left_id: (r.right_id, r.right_t - r.left_t) for r in got.itertuples()} == brute(at(left), at(right), tol)


def tables(spark, left, right):
    return (
        spark.createDataFrame(left, "label_id long, subject_id long, prediction_time timestamp_ntz").selectExpr("*", "1 as entity", "2 as t", "'x' as id"),
        spark.createDataFrame(right, "obs_id long, subject_id long, time timestamp_ntz").selectExpr("*", "1 as stretch", "2 as cell", "3 as side"),
    )


def found(df):
    return {r.left_id: (r.right_id, r.distance) for r in df.collect()}


def test_stream_against_brute_force(spark):
    rng = random.Random(11)
    hour = lambda: T + dt.timedelta(minutes=rng.randrange(24 * 60 * 90))
    left = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice([hour(), hour(), None]) if i % 7 == 0 else hour()) for i in range(300)]
    right = [(i, rng.choice([1, 1, 2, 3, None]), hour() if i % 9 else None) for i in range(500)]
    # Exactly at the tolerance, just beyond it, on the border of two stretches, far past and far ahead.
    edge = dt.datetime(1970, 1, 1)
    left += [(1000, 5, T), (1001, 6, T), (1002, 7, edge), (1003, 8, dt.datetime(1925, 5, 5)), (1004, 9, dt.datetime(2300, 1, 1)), (1005, 9, dt.datetime(2300, 1, 1))]
    right += [(1000, 5, T + dt.timedelta(hours=6)), (1001, 6, T - dt.timedelta(hours=6) - US), (1002, 7, edge - dt.timedelta(minutes=5)), (1003, 8, dt.datetime(1925, 5, 5, 1)), (1004, 9, dt.datetime(2299, 12, 31, 20))]
    # Two equally near: the earlier; many at one time: the smallest id.
    left += [(1010, 10, T)]
    right += [(5, 10, T + dt.timedelta(hours=1)), (9, 10, T - dt.timedelta(hours=1)), (7, 10, T - dt.timedelta(hours=1)), (8, 10, T - dt.timedelta(hours=1))]
    got = found(nearest_in_time(*tables(spark, left, right), rows_per_bucket=40, rows_per_slice=150))
    assert got == brute(left, right, TOL)
    assert got[1010] == (7, -3_600_000_000) and 1001 not in got and got[1004] == (1004, -4 * 3_600_000_000)


def test_empty_and_repeated(spark):
    assert found(nearest_in_time(*tables(spark, [], [(1, 1, T)]))) == {}
    assert found(nearest_in_time(*tables(spark, [(1, 1, T)], []))) == {}
    assert found(nearest_in_time(*tables(spark, [(1, 1, T)] * 3, [(4, 1, T + US)] * 3), rows_per_slice=1)) == {1: (4, 1)}


def test_one_entity_with_all_rows_in_a_day(spark):
    """Crowded stretches are cut into places, and rows across empty places, and from the stretch beside, are found as well."""
    rng = random.Random(5)
    moment = lambda: T + dt.timedelta(seconds=rng.choice([rng.randrange(3600), 40_000 + rng.randrange(9000), rng.randrange(86_400)]))
    left = [(i, 1, moment()) for i in range(250)] + [(900 + i, 1, T + dt.timedelta(hours=h)) for i, h in enumerate((-7, -5, 25, 29, 31, 47, 49))]
    right = [(i, rng.choice([1] * 40 + [2]), moment()) for i in range(1500)] + [(5000, 1, T + dt.timedelta(hours=50))]
    for length in (None, 2 * TOL):
        got = nearest_in_time(*tables(spark, left, right), rows_per_place=30, rows_per_slice=700, rows_per_bucket=100, stretch=length)
        assert found(got) == brute(left, right, TOL)
