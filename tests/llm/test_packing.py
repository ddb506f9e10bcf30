import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import packing

TOKEN = re.compile(r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\r\f\v]+")


def slow_best_fit(sizes, capacity):
    out, left = [0] * len(sizes), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [(c, b) for b, c in enumerate(left) if c >= sizes[i]]
        if fits:
            tight = min(c for c, _ in fits)
            b = next(b for c, b in reversed(fits) if c == tight)
        else:
            left.append(capacity)
            b = len(left) - 1
        left[b] -= sizes[i]
        out[i] = b
    return left


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_as_tight_as_a_search_of_all_containers(sizes):
    got = packing.best_fit_decreasing(np.array(sizes, dtype=np.int64), 40)
    used = np.bincount(got, weights=sizes) if sizes else np.array([])
    assert all(used <= 40) and sorted(40 - used) == sorted(slow_best_fit(sizes, 40))


def texts(rng):
    words = ["alpha", "b_2", "+=", "é", "(", "x", "  ", "\t", "\r\n", "\f", "\x0b", " ", "日本"]
    rows = [(i, "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.choice([1, 30, 200, 900])))) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, " \n\t"), (103, "w " * 5000), (104, "w " * 64), (105, "y" * 100_000), (None, "x")]


def test_whole_and_full(spark):
    rows = texts(random.Random(3))
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").selectExpr("*", "1 as piece", "2 as n_tokens", "3 as container")
    got = packing.pack_texts(df, capacity=64, per_task=25).collect()
    tokens = {i: len(TOKEN.findall(t)) for i, t in rows if i is not None and t is not None}
    filled, pieces = {}, {}
    for r in got:
        filled[r.container] = filled.get(r.container, 0) + r.n_tokens
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start_token, r.n_tokens, r.n_pieces))
    assert max(filled.values()) <= 64
    assert set(pieces) == {i for i, n in tokens.items() if n}
    for i, p in pieces.items():
        p.sort()
        n = -(-tokens[i] // 64)
        assert [x[0] for x in p] == list(range(n)) and all(x[3] == n for x in p) and sum(x[2] for x in p) == tokens[i]
        assert [x[1] for x in p] == [64 * k for k in range(n)]
    assert sum(filled.values()) / (64 * len(filled)) > 0.9


def test_pieces_give_the_text_back(spark):
    rows = texts(random.Random(5))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    packed = packing.pack_texts(df, capacity=64)
    by = {}
    for r in packing.piece_texts(df, packed).collect():
        by.setdefault(r.doc_id, []).append((r.piece, r.text))
    for i, t in rows:
        if i is not None and t and TOKEN.search(t):
            parts = [x for _, x in sorted(by[i])]
            assert "".join(parts) == t
            assert all(len(TOKEN.findall(x)) <= 64 for x in parts)


def test_several_texts_under_one_id(spark):
    rows = [(1, "a " * 100), (1, "b " * 40), (1, "b " * 40), (2, "c " * 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    packed = packing.pack_texts(df, capacity=64)
    got = packed.collect()
    assert sorted((r.doc_id, r.piece, r.n_tokens) for r in got) == [(1, 0, 40), (1, 0, 64), (1, 1, 36), (2, 0, 10)]
    assert sorted(r.text for r in packing.piece_texts(df, packed).collect() if r.doc_id == 1 and r.piece == 0) == ["a " * 64, "b " * 40]
    assert [r.doc_id for r in packing.split_texts(packed).collect()] == [1]


def test_split_texts_come_from_the_containers(spark):
    """Without the packing there are no such rows: they are read off its containers."""
    packed = packing.pack_texts(spark.createDataFrame([(1, "a " * 100), (2, "b " * 64), (3, "c")], "doc_id long, text string"), capacity=64)
    assert [r.doc_id for r in packing.split_texts(packed).collect()] == [1]
    assert packing.split_texts(packed.withColumn("container", packing.F.lit("one"))).count() == 0
    assert sorted(r.filled for r in packing.containers(packed).collect()) == [37, 64, 64]


def test_nothing(spark):
    assert packing.pack_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
