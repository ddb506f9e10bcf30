import random

from tallyloom.llm import leaks


def brute(docs, items, size=12):
    out = set()
    for d, t in docs:
        w = leaks.words_of(t or "")
        have = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
        for k, x in items:
            v = leaks.words_of(x or "")
            if any(tuple(v[i : i + size]) in have for i in range(len(v) - size + 1)):
                out.add((d, k))
    return out


def make(rng):
    vocabulary = [f"w{i}" for i in range(30)] + ["Given", "İ", "ſtop", "K", "a", "B9"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 12, 40])))) for i in range(30)] + [(90, None), (91, "")]
    docs = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 60]))]
        if i % 3 == 0:
            w = rng.choice(items[:30])[1].split(" ")
            cut = rng.randrange(0, max(1, len(w) - 10))
            words += w[cut : cut + rng.choice([11, 12, 20])]
        sep = rng.choice([" ", ", ", "\r\n// ", "_"])
        docs.append((i, sep.join(x.upper() if rng.random() < 0.3 else x for x in words)))
    return docs + [(500, None), (501, ""), (502, docs[0][1]), (503, "x " * 200_000 + items[2][1])], items


def brute_spans(docs, items, size=12):
    """(doc, item) and the runs of words of the document that lie in passages of the item."""
    out = []
    for d, t in docs:
        found = [(m.start(), m.end(), m[0].lower()) for m in leaks.re.finditer(leaks.ASCII_WORDS, t or "")]
        w = [x for *_, x in found]
        for k, x in items:
            v = leaks.words_of(x or "")
            have = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)}
            covered = sorted({j for i in range(len(w) - size + 1) if tuple(w[i : i + size]) in have for j in range(i, i + size)})
            for n, j in enumerate(covered):
                if n == 0 or covered[n - 1] != j - 1:
                    first = j
                if n == len(covered) - 1 or covered[n + 1] != j + 1:
                    out.append((d, k, j - first + 1, found[first][0], found[j][1]))
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    docs, items = make(random.Random(6))
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as start")
    t = spark.createDataFrame(items, "item_id long, text string")
    want = brute_spans(docs, items)
    assert {(d, k) for d, k, *_ in want} == brute(docs, items) and len(want) > 5
    assert sorted(tuple(r) for r in leaks.leaked(d, t).collect()) == want
    monkeypatch.setattr(leaks, "BLOCK", 150)
    assert sorted(tuple(r) for r in leaks.leaked(d, t).collect()) == want


def test_one_row_for_each_copy_at_any_block(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = [(1, f"{passage} " + "x " * 500 + passage), (1, f"{passage} once"), (1, f"{passage} once"), (2, " ".join(f"p{i}" for i in range(5, 25)))]
    items = [(7, passage), (8, " ".join(f"p{i}" for i in range(12, 30)))]
    # Two texts under one id: equal ones once, the other for itself.
    want = sorted(brute_spans(docs[:1], items) + brute_spans(docs[1:2], items) + brute_spans(docs[3:], items))
    assert (1, 7, 30, 0, len(passage)) in want and len([w for w in want if w[1] == 7]) == 4
    for block in (200_000, 10):
        monkeypatch.setattr(leaks, "BLOCK", block)
        got = leaks.leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
        assert sorted(tuple(r) for r in got.collect()) == want


def test_words_of_all_scripts(spark):
    text = "один два три четыре пять шесть семь восемь девять десять одиннадцать двенадцать"
    d = spark.createDataFrame([(1, f"«{text}»")], "doc_id long, text string")
    t = spark.createDataFrame([(7, text.upper())], "item_id long, text string")
    assert leaks.leaked(d, t).count() == 0
    assert tuple(leaks.leaked(d, t, word=leaks.ALL_WORDS).first()) == (1, 7, 12, 1, 1 + len(text))


def test_spans_lie_in_the_original(spark):
    passage = "One two THREE four, five-six seven eight nine ten eleven twelve"
    text = "﻿é § before\n// " + passage.replace(" ", "\r\n") + " after"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    t = spark.createDataFrame([(7, "zero " + passage + " thirteen")], "item_id long, text string")
    r = leaks.leaked(d, t).first()
    assert text[r.start : r.end] == passage.replace(" ", "\r\n") and r.n_words == 12


def test_nothing(spark):
    d = spark.createDataFrame([(1, "a " * 20)], "doc_id long, text string")
    t = spark.createDataFrame([(1, "a " * 20)], "item_id long, text string")
    assert leaks.leaked(d.limit(0), t).count() == 0 and leaks.leaked(d, t.limit(0)).count() == 0 and leaks.leaked(d, t).count() == 1
