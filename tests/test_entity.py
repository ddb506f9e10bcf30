import datetime as dt
from decimal import Decimal

from tallyloom.operators import entity

SCHEMA = "subject_id long, code string, time timestamp_ntz, numeric_value double"
T = dt.datetime(2020, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


ROWS = [
    (1, "a", T, 1.5), (1, " A ", T, 1.5), (1, "a", T + dt.timedelta(1), None), (1, "b//x", T, -0.2), (2, "B//X", T, float("nan")),
    (None, "a", T, 1.0), (1, None, T, 1.0), (3, "a", None, 4.0), (2, "a", dt.datetime(1931, 5, 1), 0.0),
]


def test_vectors_rows_and_columns(spark):
    vectors, codes = entity.feature_table(frame(spark, ROWS))
    got = {(r.subject_id, r.code): (r.n, r.total, r.latest) for r in entity.long_features(vectors, codes).collect()}
    assert got == {
        (1, "A"): (2, Decimal("1.5"), T + dt.timedelta(1)), (1, "B//X"): (1, Decimal("-0.2"), T), (2, "B//X"): (1, None, T), (2, "A"): (1, Decimal("0.0"), dt.datetime(1931, 5, 1)),
    }
    wide = entity.expand_columns(vectors, codes)
    assert wide.columns == ["subject_id", "A/count", "A/total", "A/recency", "B//X/count", "B//X/total", "B//X/recency"]
    assert sorted(tuple(r) for r in wide.collect()) == [(1, 2, 1.5, T + dt.timedelta(1), 1, -0.2, T), (2, 1, 0.0, dt.datetime(1931, 5, 1), 1, None, T)]
    some = entity.expand_columns(vectors, codes, ["count"], codes=["B//X"])
    assert sorted(tuple(r) for r in some.collect()) == [(1, 1), (2, 1)]


def test_top_codes_with_ties(spark):
    vectors, codes = entity.feature_table(frame(spark, ROWS))
    got = sorted(tuple(r) for r in entity.top_codes(vectors, codes).collect())
    assert got == [(1, "count", "A"), (1, "recency", "A"), (1, "total", "A"), (2, "count", "A"), (2, "count", "B//X"), (2, "recency", "B//X"), (2, "total", "A")]


def test_merging_equals_the_whole(spark):
    rows = [(s, c, T + dt.timedelta(i), float(i)) for i, (s, c) in enumerate([(1, "a"), (1, "b"), (2, "a")] * 5)]
    codes = entity.code_index(frame(spark, rows))
    whole = entity.entity_vectors(entity.encode_events(frame(spark, rows), codes))
    parts = [entity.entity_vectors(entity.encode_events(frame(spark, part), codes)) for part in (rows[:7], rows[7:])]
    read = lambda v: {r.subject_id: r.vec for r in v.collect()}
    assert read(entity.merge_vectors(*parts)) == read(whole)


def test_empty_and_clashing(spark):
    vectors, codes = entity.feature_table(frame(spark, []))
    assert vectors.count() == codes.count() == entity.top_codes(vectors, codes).count() == entity.expand_columns(vectors, codes).count() == 0
    df = frame(spark, ROWS).selectExpr("*", "1 as idx", "2 as spelling", "3 as vec", "4 as n")
    assert entity.feature_table(df)[0].count() == 2


def test_shuffled_dictionary_gives_the_same(spark, monkeypatch):
    expected = sorted(tuple(r) for r in entity.top_codes(*entity.feature_table(frame(spark, ROWS))).collect())
    monkeypatch.setattr(entity, "BROADCAST_SPELLINGS", 0)
    assert sorted(tuple(r) for r in entity.top_codes(*entity.feature_table(frame(spark, ROWS))).collect()) == expected
