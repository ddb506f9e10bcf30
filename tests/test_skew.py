import math
import random
from collections import defaultdict

from tallyloom.operators import skew
from tallyloom.operators.skew import heavy_keys, hot_keys, key_quantiles, skew_lookup

SCHEMA = "subject_id long, numeric_value double"


def brute(rows, probs=(0.25, 0.5, 0.75)):
    values, counts = defaultdict(list), defaultdict(int)
    for k, v in rows:
        counts[k] += 1
        if v is not None and math.isfinite(v):
            values[k].append(v)
    out = {}
    for k, n in counts.items():
        v = sorted(values[k])
        out[k] = (n, len(v), *[v[max(1, math.ceil(p * len(v))) - 1] if v else None for p in probs])
    return out


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_exact_with_a_hot_key_and_hard_values(spark):
    rng = random.Random(3)
    hot = [(1, rng.choice([rng.gauss(0, 1), 5e-324, 1e300, -1e300, 1 + rng.randrange(4) * 2**-52, 0.0, -0.0, rng.uniform(-1e6, 1e6)])) for _ in range(3000)]
    rest = [(rng.choice([2, 3, None]), rng.choice([None, float("nan"), float("inf"), 1.5, 2.5, -3.0])) for _ in range(300)] + [(4, None)]
    rows = hot + rest
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(key_quantiles(df, buckets=8)) == brute(rows)
    assert got(key_quantiles(df, buckets=8, least_hot=20, salts=5)) == brute(rows)  # hot keys, the null one too, by a salt


def test_counts_come_from_the_refined_histogram(spark, monkeypatch):
    """Where no rank is resolved, no value is counted."""
    df = spark.createDataFrame([(1, float(i)) for i in range(40)] + [(1, None), (2, None)], SCHEMA)
    assert got(key_quantiles(df))[1][:2] == (41, 40)
    monkeypatch.setattr(skew, "_coarse", lambda v: skew.F.lit(None).cast("int"))
    assert got(key_quantiles(df))[1][1] == 0


def test_ties_repeats_and_extremes(spark):
    rows = [(1, 2.0)] * 7 + [(1, 3.0)] * 3 + [(2, -1.0)]
    probs = (0.0, 0.7, 0.71, 1.0)
    assert got(key_quantiles(spark.createDataFrame(rows, SCHEMA), probs=probs)) == brute(rows, probs)


def test_empty_and_clashing_columns(spark):
    assert key_quantiles(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, 2.0)], SCHEMA).selectExpr("*", "1 as k", "2 as v", "3 as c", "4 as n_rows", "5 as salt")
    assert got(key_quantiles(df)) == {1: (1, 1, 2.0, 2.0, 2.0)}


def test_string_keys(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 4.0), (None, 1.0)], "name string, x double")
    assert got(key_quantiles(df, "name", "x", (0.5,))) == {"a": (2, 2, 2.0), None: (1, 1, 1.0)}


def test_heavy_keys_count_nulls_and_repeats(spark):
    rows = [(1, None)] * 2 + [(None, 1.0)] * 50 + [(k, 1.0) for k in range(100, 148)]
    assert [r[0] for r in heavy_keys(key_quantiles(spark.createDataFrame(rows, SCHEMA))).select("subject_id").collect()] == [1]


def test_lookup_is_a_left_join(spark):
    left = spark.createDataFrame([(1, i) for i in range(3000)] + [(i, i) for i in range(2, 400)] + [(None, 0)], "k long, i long")
    right = spark.createDataFrame([(i, str(i)) for i in range(0, 300)], "id long, name string")
    hot = hot_keys(left, "k", 100, 500)
    assert hot == [1] and hot_keys(left, "k") == []
    out = skew_lookup(left, "k", right, "id", ["name"], hot)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, skew_lookup(left, "k", right, "id", ["name"]).collect()), key=repr)
    assert out.count() == left.count()
    assert out.where("k = 1 and name = '1'").count() == 3000 and out.where("name is null").count() == 101
