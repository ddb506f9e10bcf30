import datetime as dt
import itertools
from unittest import mock

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import types as SparkT

from tallyloom.functions import names
from tallyloom.operators import asof, assemble, describe, features, metrics, models, neighbours, ordering, prep, rolling, selection, static, subsets, sweep, task, tasks
from tallyloom.schema import OBSERVATIONS, TabConfig, conform, kind_of, parse_window

OBS = "subject_id long, time timestamp_ntz, code string, numeric_value double"
T = dt.datetime(2020, 1, 1)
H = dt.timedelta(hours=1)
D = dt.timedelta(days=1)


def obs(spark, rows):
    return spark.createDataFrame(rows, OBS)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


# -- names, windows, configuration -------------------------------------------------------------


def test_names():
    for kind in ("code", "value", "static/present", "static/first"):
        assert names.split_name(f"SOIL//PH.5/{kind}") == ("SOIL//PH.5", kind)
    for bad in ("SOIL", "static/present"):
        with pytest.raises(ValueError):
            names.split_name(bad)
    assert names.without_last_part("SOIL//PH.5/value/sum") == "SOIL//PH.5/value" and names.without_last_part("SOIL") == ""
    assert names.parse_static("SOIL//PH.5/static/present") == ("SOIL//PH.5", "static", "present")
    with pytest.raises(ValueError):
        names.parse_static("static/present")
    assert names.column_name("SOIL//PH.5/value", "value/max", "12h") == "SOIL//PH.5/value/max/12h"
    assert names.column_name("SOIL//PH.5/static/first", "static/first", None) == "SOIL//PH.5/static/first"


def test_name_columns(spark):
    df = spark.createDataFrame([("A/code",), ("A/B/static/first",), ("A",)], "c string")
    got = df.select(names.bare_code(df.c), names.kind_column(df.c), names.without_last_part_column(df.c)).collect()
    assert [tuple(r) for r in got] == [("A", "code", "A"), ("A/B", "static/first", "A/B/static"), ("A", None, "")]


def test_windows():
    assert parse_window("7d") == 7 * 86_400_000_000 and parse_window("1d 6h") == 30 * 3_600_000_000 and parse_window("full") is None
    for bad in ("", "d", "7x", "0d", "-1d"):
        with pytest.raises(ValueError):
            parse_window(bad)
    assert kind_of("value/sum_sqd") == "value"
    with pytest.raises(ValueError):
        kind_of("value/has_values_count")


def test_config():
    c = TabConfig().with_overrides(["windows=[30d,full]", "min_code_count=3", "overwrite=true", "label_dir=/x", "aggs=code/count"])
    assert (c.windows, c.min_code_count, c.overwrite, c.label_dir, c.aggs) == (("30d", "full"), 3, True, "/x", ("code/count",))
    for bad in ("nothing=1", "windows=[x]", "aggs=[value/mean]"):
        with pytest.raises(ValueError):
            TabConfig().with_overrides([bad])


def test_conform(spark):
    with pytest.raises(ValueError):
        conform(spark.range(1), OBSERVATIONS)


# -- describe and selection --------------------------------------------------------------------


def test_describe(spark):
    rows = [(1, None, "A", 1.0), (1, None, "B", None), (1, T, "C", 1.0), (1, T, "C", None), (2, T, "A", None), (None, T, "A", 1.0), (1, T, None, 1.0)]
    got = describe.as_dict(describe.code_frequencies(obs(spark, rows)))
    assert got == {"A/static/present": 1, "A/static/first": 1, "B/static/present": 1, "C/code": 2, "C/value": 1, "A/code": 1}
    parts = [describe.code_frequencies(obs(spark, p)) for p in (rows[:3], rows[3:])]
    assert describe.as_dict(describe.merge_frequencies(*parts)) == got
    assert describe.as_dict(describe.from_dict(spark, got)) == got
    assert describe.code_frequencies(obs(spark, [])).count() == 0


def test_selection(spark):
    freq = describe.from_dict(spark, {"RAIN/code": 50, "WIND/code": 30, "WIND/value": 15, "FOG/code": 5})
    select = lambda **k: features.selected_names(features.select_features(freq, **k))
    assert select() == ["FOG/code", "RAIN/code", "WIND/code", "WIND/value"]
    assert select(allowed=["FOG/code", "WIND/value", "HAIL/code"]) == ["FOG/code", "WIND/value"]
    assert select(min_count=15) == ["RAIN/code", "WIND/code", "WIND/value"] and select(max_features=2) == ["RAIN/code", "WIND/code"]
    assert select(min_frequency=0.3) == ["RAIN/code", "WIND/code"] and select(min_frequency=0.31) == ["RAIN/code"]
    # The share is taken of what the allowed list leaves: 15 of 20.
    assert select(allowed=["FOG/code", "WIND/value"], min_frequency=0.7) == ["WIND/value"]
    for bad in ({"allowed": ["HAIL/code"]}, {"min_count": 51}, {"min_frequency": 1.5}):
        with pytest.raises(ValueError):
            select(**bad)
    tied = describe.from_dict(spark, {f"{c}/code": 9 for c in "ZKQ"})
    assert features.selected_names(features.select_features(tied, max_features=2)) == ["K/code", "Q/code"]
    assert [c for c, _ in rows_of(features.feature_index(freq))] == select() and [n for _, n in rows_of(features.feature_index(freq))] == [0, 1, 2, 3]


def test_rare(spark):
    """Every kind of feature that may be selected of a code, against each kind of row: kept with its value, kept without, or dropped."""
    kinds, rows, want = ("code", "value", "static/present", "static/first"), [], []
    listed = {}
    for n in range(16):
        code = f"GAUGE//{n}"
        has = {k for i, k in enumerate(kinds) if n >> i & 1}
        listed |= {f"{code}/{k}": 1 for k in has}
        for time, row, value in ((T, "code", "value"), (None, "static/present", "static/first")):
            rows.append((n, time, code, n + 0.5))
            if row in has:
                want.append((n, time, code, n + 0.5 if value in has else None))
    assert rows_of(features.drop_rare(obs(spark, [*rows, (1, T, None, 7.0)]), describe.from_dict(spark, listed))) == rows_of(obs(spark, want))
    kept = features.events_of(obs(spark, rows), describe.from_dict(spark, {"GAUGE//3/code": 1, "GAUGE//4/value": 1, "GAUGE//5/static/first": 1}))
    assert rows_of(kept, "code") == [("GAUGE//3",), ("GAUGE//4",)]
    assert rows_of(features.event_index(kept)) == [(3, T), (4, T)]


# -- statics -----------------------------------------------------------------------------------


def test_static(spark):
    rows = [(7, None, "DEPTH", 10.0), (7, None, "DEPTH", None), (7, None, "DEPTH", 16.0), (7, None, "SALT//LOW", None), (8, None, "DEPTH", None), (8, T, "DEPTH", 99.0), (9, None, "SALT//LOW", 0.0)]
    o = obs(spark, rows)
    assert rows_of(static.static_first(o)) == [(7, "DEPTH", 13.0), (9, "SALT//LOW", 0.0)]
    assert rows_of(static.static_present(o)) == [(7, "DEPTH", True), (7, "SALT//LOW", True), (8, "DEPTH", True), (9, "SALT//LOW", True)]
    wide = static.static_wide(o, ["SALT//LOW", "DEPTH", "ICE"], ["DEPTH"])
    assert wide.columns == ["subject_id", "SALT//LOW/static/first", "DEPTH/static/first", "ICE/static/first", "DEPTH/static/present"]
    assert rows_of(wide) == [(7, None, 13.0, None, True), (8, None, None, None, True), (9, 0.0, None, None, False)]
    index = spark.createDataFrame([(7, T), (7, T + H), (6, T)], "subject_id long, time timestamp_ntz")
    assert rows_of(static.replicate_static(index, wide), "subject_id", "`DEPTH/static/first`") == [(6, None), (7, 13.0), (7, 13.0)]
    with pytest.raises(ValueError):
        static.static_wide(o)


# -- rolling -----------------------------------------------------------------------------------


def naive(index, rows, windows):
    out = {}
    for (s, t), w in itertools.product(set(index), windows):
        size = parse_window(w)
        for code in {r[2] for r in rows if r[2]}:
            inside = [r[3] for r in rows if r[0] == s and r[2] == code and r[1] is not None and r[1] <= t and (size is None or r[1] > t - dt.timedelta(microseconds=size))]
            v = [x for x in inside if x is not None]
            if inside:
                out[s, t, code, w] = (len(inside), len(v), round(sum(v), 6) if v else None, round(sum(x * x for x in v), 6) if v else None, min(v, default=None), max(v, default=None))
    return out


def rolled(df):
    return {(r.subject_id, r.time, r.code, r.window): (r.code_count, r.value_count, *[x if x is None else round(x, 6) for x in (r.value_sum, r.value_sum_sqd)], r.value_min, r.value_max) for r in df.collect()}


EVENT = st.tuples(st.sampled_from([1, 2]), st.one_of(st.none(), st.integers(-200, 200).map(lambda h: T + 3 * h * H)), st.sampled_from(["A", "B//x/y", None]), st.sampled_from([None, 0.0, -1.5, 2.5]))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(EVENT, min_size=1, max_size=25))
def test_all_plans_and_a_naive_one_agree(spark, rows):
    windows = ["6h", "7d", "full"]
    o = obs(spark, rows)
    index = [(r[0], r[1]) for r in rows if r[1] is not None]
    table = features.event_index(o)
    expected = naive(index, rows, windows)
    for short in (256, 12, 4, 0):  # all histories are short, some are, none is
        with mock.patch.object(rolling, "_SHORT", short):
            assert rolled(rolling.rolling_features(table, o, windows, scale=1)) == expected
    assert rolled(rolling.rolling_by_spine(table, o, windows, scale=1)) == expected


@pytest.mark.parametrize("short", [256, 0])
def test_edges_of_a_window(spark, monkeypatch, short):
    """A window holds its own time and not the one a whole length before it; rows of one time are all in it, with and without values."""
    monkeypatch.setattr(rolling, "_SHORT", short)
    us = dt.timedelta(microseconds=1)
    ticks = [(4, T, "TICK", 1.0), (4, T + us, "TICK", 10.0), (4, T + 5 * H, "TICK", None), (4, T + 5 * H, "TICK", -4.0), (4, T + 5 * H + us, "TICK", 100.0)]
    o = obs(spark, ticks)
    got = {t: v for (_, t, _, _), v in rolled(rolling.rolling_features(features.event_index(o), o, ["5h"])).items()}
    assert got == {
        T: (1, 1, 1.0, 1.0, 1.0, 1.0), T + us: (2, 2, 11.0, 101.0, 1.0, 10.0),
        T + 5 * H: (3, 2, 6.0, 116.0, -4.0, 10.0), T + 5 * H + us: (3, 2, 96.0, 10016.0, -4.0, 100.0),
    }


@pytest.mark.parametrize("short", [256, 0])
def test_rows_off_the_events(spark, monkeypatch, short):
    monkeypatch.setattr(rolling, "_SHORT", short)
    o = obs(spark, [(1, T, "A", 1.0), (1, T + 2 * D, "A", 2.0)])
    index = spark.createDataFrame([(1, T - D), (1, T + D), (1, T + 30 * D), (2, T)], "subject_id long, time timestamp_ntz")
    got = rolled(rolling.rolling_features(index, o, ["2d", "full"]))
    assert {k: v[2] for k, v in got.items()} == {(1, T + D, "A", "2d"): 1.0, (1, T + D, "A", "full"): 1.0, (1, T + 30 * D, "A", "full"): 3.0}


@pytest.mark.parametrize("short", [256, 0])
def test_rolling_arguments(spark, monkeypatch, short):
    monkeypatch.setattr(rolling, "_SHORT", short)
    o = obs(spark, [])
    index = features.event_index(o)
    assert rolling.rolling_features(index, o, ["1d", "full"]).count() == 0
    for bad in ({"aggs": ["static/first"]}, {"aggs": ["value/has_values_count"]}, {"aggs": []}, {"windows": []}):
        with pytest.raises(ValueError):
            rolling.rolling_features(index, o, **({"windows": ["1d"]} | bad))


def test_bounds(spark):
    """Against a count by hand, over several years, so that windows reach into chunks before."""
    hours = sorted({h * h * 3 % 30_000 for h in range(60)})
    times = {1: [T + h * H for h in hours], 2: [T, T + 10 * H]}
    index = spark.createDataFrame([(s, t) for s, ts in times.items() for t in ts] + [(None, T), (1, None)], "subject_id long, time timestamp_ntz")
    for window, size in (("10h", 10 * H), ("90d", 90 * D), ("full", None)):
        got = {(r.subject_id, r.time): (r.min_index, r.max_index) for r in rolling.window_bounds(index, window).collect()}
        assert got == {(s, t): (sum(1 for u in ts if size and u <= t - size), sum(1 for u in ts if u <= t)) for s, ts in times.items() for t in ts}
    assert rolling.window_bounds(index.limit(0), "7d").count() == 0


# -- as-of and tasks ---------------------------------------------------------------------------


def naive_asof(t, times, forward, strict):
    if t is None:
        return None
    ok = [x for x in times if (x > t if strict else x >= t)] if forward else [x for x in times if (x < t if strict else x <= t)]
    return min(ok, default=None) if forward else max(ok, default=None)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([1, 2]), st.integers(0, 300)), max_size=15), st.lists(st.tuples(st.sampled_from([1, 2, 3]), st.integers(-20, 320)), min_size=1, max_size=15), st.booleans())
def test_asof(spark, events, left, strict):
    e = spark.createDataFrame([(s, T + d * D) for s, d in events], "subject_id long, time timestamp_ntz")
    rows = [(s, T + d * D, i) for i, (s, d) in enumerate(left)] + [(1, None, 99)]
    x = spark.createDataFrame(rows, "subject_id long, time timestamp_ntz, i long")
    times = {s: [T + d * D for k, d in events if k == s] for s in (1, 2, 3)}
    for forward, f in ((False, asof.latest_before), (True, asof.next_after)):
        got = {r.i: r.event_time for r in f(x, e, strict=strict).collect()}
        assert got == {i: naive_asof(t, times[s], forward, strict) for s, t, i in rows}
    got = {r.i: r.n for r in asof.count_until(x, e, "time", "n", strict=strict).collect()}
    assert got == {i: sum(1 for y in times[s] if t and (y < t if strict else y <= t)) for s, t, i in rows}


def test_labels(spark):
    labels = spark.createDataFrame([(1, T + D, 1, 5), (1, T + D, 0, 4), (1, T - D, 1, 6), (9, T, 1, 7), (1, None, 1, 8)], "subject_id long, time timestamp_ntz, label int, n long")
    first = task.first_labels(labels, ["n"])
    assert rows_of(first, "subject_id", "time", "label") == [(1, T - D, 1), (1, T + D, 0), (9, T, 1)]
    o = obs(spark, [(1, T, "A", 2.0), (1, T + 3 * D, "A", 1.0)])
    got = task.align_labels(first.select("subject_id", "time", "label"), features.event_index(o))
    assert rows_of(got) == [(1, T - D, 1, None, -1), (1, T + D, 0, T, 0)]
    cells = rolling.melt(task.label_features(first, o, ["2d"]))
    assert rows_of(cells.where("agg = 'value/sum'"), "time", "value") == [(T + D, 2.0)]
    # The window of a label that is long after the last event ends at that event, unless anchored at the label.
    late = spark.createDataFrame([(1, T + 400 * D, 1)], "subject_id long, time timestamp_ntz, label int")
    assert task.label_features(late, o, ["2d"]).count() == 1
    assert task.label_features(late, o, ["2d"], anchor="label").count() == 0
    with pytest.raises(ValueError):
        task.label_features(late, o, ["2d"], anchor="x")
    assert rows_of(task.binarized(late)) == [(1, T + 400 * D, 1)] and task.classes(labels) == [0, 1]


def test_task_language(spark):
    o = obs(spark, [(1, T, "IN", None), (1, T + 2 * H, "X", 4.0), (1, T + 30 * H, "OUT", None), (1, T + 31 * H, "DEAD", None), (2, T, "IN", None), (2, T + 90 * H, "X", 9.0)])
    spec = {
        "predicates": {"in": {"code": "IN"}, "out": {"code": {"any": ["OUT"]}}, "dead": {"code": {"regex": "^DEAD"}}, "high": {"code": "X", "value_min": 5}, "end": {"expr": "or(out, dead)"}},
        "trigger": "in",
        "windows": {
            "input": {"start": None, "end": "trigger + 24h", "has": {"_ANY_EVENT": "(2, None)"}, "index_timestamp": "end"},
            "stay": {"start": "trigger", "end": "start -> end", "start_inclusive": False, "has": {"high": "(None, 0)"}},
            "target": {"start": "stay.end", "end": None, "label": "dead"},
        },
    }
    assert rows_of(tasks.extract_labels(o, spec)) == [(1, T + D, True)]
    back = {"predicates": {"x": {"code": "X"}, "in": {"code": "IN"}}, "trigger": "x", "windows": {"w": {"start": "end <- in", "end": "trigger", "label": "x", "end_inclusive": False}}}
    assert rows_of(tasks.extract_labels(o, back)) == [(1, T + 2 * H, False), (2, T + 90 * H, False)]
    for bad in ({"start": "nowhere.end", "end": None}, {"start": "trigger ? 3", "end": None}):
        with pytest.raises(ValueError):
            tasks.extract_labels(o, {"predicates": {"in": {"code": "IN"}}, "trigger": "in", "windows": {"w": bad}})
    with pytest.raises(ValueError):
        tasks.extract_labels(o, {"predicates": {}, "trigger": "q", "windows": {}})


# -- ordering, metrics, preparation, models ----------------------------------------------------


def test_numbers_and_totals(spark):
    df = spark.createDataFrame([(i * 7 % 100, i) for i in range(100)], "a long, b long")
    got = ordering.number_rows(df, ["a"], "n").collect()
    assert all(r.a == r.n for r in got)
    assert ordering.number_rows(df.limit(0), ["a"], "n").count() == 0
    ordering.assert_sorted(spark.range(10), ["id"])
    ordering.assert_sorted(spark.range(0, 40, 1, 7), ["id"])
    ordering.assert_sorted(spark.range(0), ["id"])
    for bad in (df.coalesce(1), spark.range(0, 4, 1, 1).union(spark.range(2, 6, 1, 1)).toDF("a"), spark.range(3).selectExpr("nullif(id, 1) as a")):
        with pytest.raises(ValueError):
            ordering.assert_sorted(bad, ["a"])
    with pytest.raises(ValueError):  # each partition is sorted, the fall lies between two, and one between them is empty
        ordering.assert_sorted(spark.range(5, 9, 1, 1).union(spark.range(0, 0, 1, 1)).union(spark.range(0, 4, 1, 1)), ["id"])


def test_auc(spark):
    pairs = [(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1), (0, 0.1), (1, None), (None, 0.3)]
    df = spark.createDataFrame(pairs, "label int, score double")
    p, n = [0.9, 0.4], [0.9, 0.1, 0.1]
    assert metrics.auc_value(df) == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in p for b in n) / 6)
    assert metrics.auc_value(df.where("label = 1")) == 0.0 and metrics.auc_value(df.limit(0)) == 0.0


CELLS = "subject_id long, time timestamp_ntz, window string, agg string, code string, value double"


def test_assembly(spark):
    listed = assemble.column_table(["B/code", "A/code", "A/value", "S/static/present"], ["full", "1d"], ["static/present", "code/count", "value/sum"])
    assert [c[4] for c in listed] == ["A/code/count/1d", "B/code/count/1d", "A/value/sum/1d", "A/code/count/full", "B/code/count/full", "A/value/sum/full", "S/static/present"]
    assert assemble.column_names(["A/code"], ["1d"], ["code/count"], [0]) == ["A/code/count/1d"]
    cells = spark.createDataFrame([(1, T, "1d", "code/count", "B", 2.0), (1, T, None, "static/present", "S", 1.0), (1, T, "1d", "value/sum", "A", 0.0), (1, T, "1d", "value/sum", "Z", 4.0)], CELLS)
    rows = spark.createDataFrame([(1, T), (2, T)], "subject_id long, time timestamp_ntz")
    got = {r.subject_id: r.features for r in assemble.sparse_vectors(rows, cells, listed).collect()}
    assert list(got[1].indices) == [1, 6] and list(got[1].values) == [2.0, 1.0] and got[2].numNonzeros() == 0 and got[2].size == 7
    dense = assemble.dense_columns(rows, cells, listed).orderBy("subject_id").collect()
    assert dense[0]["B/code/count/1d"] == 2.0 and dense[1]["S/static/present"] == 0.0


def test_correlation(spark):
    labels = spark.createDataFrame([(i, T, i % 2) for i in range(6)], "subject_id long, time timestamp_ntz, label int")
    cells = spark.createDataFrame([(i, T, "1d", "code/count", "A", 2.0) for i in (1, 3, 5)] + [(i, T, "1d", "code/count", "B", 1.0) for i in range(6)] + [(0, T, "1d", "value/sum", "C", 1.0)], CELLS)
    r = {x.code: x.r for x in selection.label_correlation(labels, cells).collect()}
    assert r["A"] == pytest.approx(1.0) and r["B"] is None and -1 < r["C"] < 0
    got = selection.label_correlation(labels, cells)
    assert rows_of(selection.select_max_by_correlation(got, 1)) == [("A",)]
    assert rows_of(selection.select_min_correlation(got, 0.9)) == [("A",)]
    with pytest.raises(ValueError):
        selection.label_correlation(labels.where("label = 1"), cells)


def test_preparation(spark):
    cells = spark.createDataFrame([(1, T, "1d", "value/sum", "A", 1.0), (2, T, "1d", "value/sum", "A", 2.0), (3, T, "1d", "value/sum", "A", 2.0), (1, T, "1d", "value/sum", "B", -4.0)], CELLS)
    assert rows_of(prep.max_abs_scale(cells), "code", "value") == [("A", 0.5), ("A", 1.0), ("A", 1.0), ("B", -1.0)]
    # 0, 1, 2, 2 with one absent row: population variance 0.6875.
    assert prep.standard_scale(cells, 4).where("code = 'A' and subject_id = 1").first().value == pytest.approx(1 / 0.6875**0.5)
    fill = lambda s, n=None: {r.code: r.fill for r in prep.fill_values(cells, s, n_rows=n).collect()}
    assert fill("mean")["A"] == pytest.approx(5 / 3) and fill("median")["A"] == 2.0 and fill("mode")["A"] == 2.0
    assert fill("mean", 5)["A"] == 1.0 and fill("median", 4)["B"] == 0.0 and fill("mode", 5)["A"] == 0.0
    rows = spark.createDataFrame([(1, T), (4, T)], "subject_id long, time timestamp_ntz")
    assert rows_of(prep.impute(rows, cells, "mode"), "subject_id", "code", "value") == [(1, "A", 1.0), (1, "B", -4.0), (4, "A", 2.0), (4, "B", -4.0)]
    with pytest.raises(ValueError):
        prep.fill_values(cells, "guess")


def test_dense_windows_by_running_aggregates(spark, capsys):
    """Long histories: no frame is bound at both ends, whose rows would be gone through at every point, and sums are of what a window holds alone."""
    rows = [(1, T + i * H / 2, "A" if i % 3 else "B", [1e16, 1.0, None, -3.5][i % 4] if i < 150 else float(i % 5)) for i in range(400)]
    events = spark.createDataFrame(rows, OBS)
    windows = {"1h": H, "2d": 2 * D, "365d": 365 * D}
    out = rolling.rolling_features(events, events, list(windows), ["code/count", "value/sum", "value/min"])
    out.explain(True)
    frames = [f.split(")")[0] for f in capsys.readouterr().out.split("specifiedwindowframe(")[1:]]
    assert frames and all("unbounded" in f or "RowFrame" in f for f in frames)
    got = {(r.time, r.code, r.window): (r.code_count, r.value_sum, r.value_min) for r in out.collect()}
    want = {}
    for w, size in windows.items():
        for t in (r[1] for r in rows):
            for code in "AB":
                held = [r[3] for r in rows if r[2] == code and t - size < r[1] <= t]
                values = [v for v in held if v is not None]
                if held:
                    want[t, code, w] = (len(held), pytest.approx(sum(values), rel=1e-12) if values else None, min(values, default=None))
    assert got == want


def test_all_windows_move_rows_once(spark, monkeypatch):
    """Long histories: more windows shuffle no more often; codes of a chunk are shared out; sums past 64 bits are exact."""
    for name, value in (("_SHORT", 0), ("_GROUP_ROWS", 20), ("_GROUP_CELLS", 300), ("_WHOLE_ROWS", 30)):
        monkeypatch.setattr(rolling, name, value)
    rows = [(1 + i % 7 // 6, T + i * i % 997 * D, "ABCD"[i % 4], [1e15 + 1, 2.5, None, -4.0][i // 4 % 4]) for i in range(160)]
    o, index = obs(spark, rows), [(r[0], r[1]) for r in rows]
    windows = ["1d", "5d", "30d", "365d", "800d", "full"]
    out, two = (rolling.rolling_features(features.event_index(o), o, w, scale=1) for w in (windows, ["365d", "full"]))
    plans = [df._jdf.queryExecution().executedPlan().toString().count("Exchange ") for df in (out, two)]
    assert plans[0] == plans[1]
    got, want = rolled(out), naive(index, rows, windows)
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(value, rel=1e-14) if value[1] else got[key] == value


@pytest.mark.parametrize(("weights", "p"), [("uniform", 2), ("distance", 1)])
def test_neighbours(spark, weights, p):
    points = [(i, float(i * i % 7), float(i % 3), i % 2) for i in range(40)]
    asked = [(100, 0.0, 0.0), (101, 3.0, 1.5), (102, None, 2.0)]
    train = spark.createDataFrame(points, "id long, x double, y double, label int")
    queries = spark.createDataFrame(asked, "id long, x double, y double")
    got = {r.id: r.score for r in neighbours.knn_scores(train, queries, ["x", "y"], "id", k=5, weights=weights, p=p, block=2).collect()}
    for key, x, y in asked:
        d = sorted(((abs((x or 0) - a) ** p + abs(y - b) ** p) ** (1 / p), lab) for _, a, b, lab in points)[:5]
        exact = [lab for e, lab in d if e == 0]
        want = sum(lab for _, lab in d) / 5 if weights == "uniform" else sum(exact) / len(exact) if exact else sum(lab / e for e, lab in d) / sum(1 / e for e, _ in d)
        assert got[key] == pytest.approx(want)


def test_neighbours_read_once(spark):
    """Rows at one place are one point, each side is read once whatever the number of blocks, and ties go by label."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    rng = np.random.default_rng(5)
    at, label, wanted = rng.integers(0, 6, (900, 2)).astype(float), rng.integers(0, 2, 900), rng.integers(-1, 7, (300, 2)).astype(float)
    kind = "id long, x double, y double, label int"
    train = spark.createDataFrame([(i, *map(float, p), int(lab)) for i, (p, lab) in enumerate(zip(at, label, strict=True))], kind).mapInPandas(seen, kind)
    queries = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(wanted)], "id long, x double, y double").mapInPandas(seen, "id long, x double, y double")
    got = {r.id: r.score for r in neighbours.knn_scores(train, queries, ["x", "y"], "id", k=30, block=20).collect()}
    assert read.value == 1200 and len(got) == 300
    for i, p in enumerate(wanted):
        d = ((at - p) ** 2).sum(axis=1)
        assert got[i] == pytest.approx(label[np.lexsort((label, d))][:30].mean())


@pytest.mark.parametrize("p", [1, 2])
def test_neighbours_boxes(p):
    """Searching boxes finds what looking at all points finds, NaN and all."""
    rng = np.random.default_rng(p)
    x, y, n, q = (4 * rng.normal(size=(3000, 3))).round() / 4, rng.integers(0, 2, 3000), rng.integers(1, 4, 3000), (4 * rng.normal(size=(200, 3))).round() / 4
    x[7, 1] = q[3, 0] = np.nan
    assert sorted(np.concatenate(neighbours.boxes(x))) == list(range(3000)) and max(map(len, neighbours.boxes(x))) <= 64
    for group, d, labels, counts in neighbours.nearest_points(neighbours.tree_of(x, y, n), q, 6, p):
        for i, row, lab, c in zip(group, d, labels, counts, strict=True):
            far = (np.abs(x - q[i]) ** p).sum(axis=1)
            want = [e for j in np.lexsort((y, far)) for e in [(far[j] ** (1 / p), y[j])] * n[j]][:6]
            found = [(e, b) for e, b, m in zip(row, lab, c, strict=True) for _ in range(m)][:6]
            assert [b for _, b in found] == [b for _, b in want] and np.allclose([e for e, _ in found], [e for e, _ in want], equal_nan=True)


def test_neighbours_as_a_model(spark, tmp_path):
    rows = [(i, T, i % 2, Vectors.sparse(3, {0: float(i % 2), 1: i / 40})) for i in range(30)] + [(90, T, None, Vectors.sparse(3, {}))]
    kinds = spark.createDataFrame([], "subject_id long, time timestamp_ntz, label int").schema
    data = spark.createDataFrame(rows, SparkT.StructType([*kinds, SparkT.StructField("features", VectorUDT())]))
    model = models.make_model("knn", k=3)
    with pytest.raises(ValueError):
        model.scores(data)
    model.train(data)
    scored = {r.subject_id: r.score for r in model.scores(data).collect()}
    assert scored.keys() == {*range(30), 90} and all(scored[i] == i % 2 for i in range(30)) and model.evaluate(data) == 1.0
    model.save(str(tmp_path / "knn"))
    again = models.NeighbourModel.load(spark, str(tmp_path / "knn"))
    assert again.params == model.params and {r.subject_id: r.score for r in again.scores(data).collect()} == scored
    with pytest.raises(ValueError):
        models.make_model("oracle")


def test_subsets():
    found = subsets.non_empty_subsets(["1d", "30d", "full"])
    assert len(found) == 7 and len({tuple(x) for x in found}) == 7 and found == sorted(found)
    assert subsets.as_choices([["1d"], ["1d", "full"]]) == "[1d],[1d,full]"


def test_sweep(spark, tmp_path):
    trials = sweep.sample_trials({"a": [1, 2, 3], "b": (0.0, 1.0), "c": (1, 9), "d": "x"}, 4, seed=5)
    assert trials == sweep.sample_trials({"a": [1, 2, 3], "b": (0.0, 1.0), "c": (1, 9), "d": "x"}, 4, seed=5)
    drawn = [t["x"] for t in sweep.sample_trials({"x": ("log", 1e-4, 1.0)}, 400, seed=1)]
    assert 0.4 < sum(x < 0.01 for x in drawn) / 400 < 0.6 and all(1e-4 <= x <= 1 for x in drawn)
    assert all(isinstance(t["x"], int) for t in sweep.sample_trials({"x": ("log", 1, 1000)}, 5, seed=1))
    aucs = iter([0.7, 0.9, 0.8, 0.6])
    # A URI, as of a shared file system; the first trial is drawn twice.
    sweep.run_sweep(spark, [*trials, trials[0]], lambda params, place: (next(aucs), 0.5), f"file:{tmp_path}", threads=1)
    (tmp_path / "notes").mkdir()
    best = sweep.finish_sweep(spark, f"file:{tmp_path}", 2)
    assert (tmp_path / "best_trial" / "config.json").read_text() == (tmp_path / best / "config.json").read_text()
    assert sweep.finish_sweep(spark, f"file:{tmp_path}", 2) == best
    left = {p.name for p in tmp_path.iterdir() if p.is_dir() and not p.name.endswith(".parquet")}
    assert best == sweep.trial_name(trials[1]) and left == {best, sweep.trial_name(trials[2]), "notes", "best_trial"}
