"""Held-out test passages inside a corpus, found by Aho-Corasick automata over the normalised test texts."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.workspace import staged

#: A word: a longest run of ASCII letters and digits, or, if asked, of letters and digits of any script.
ASCII_WORDS, ALL_WORDS = r"[A-Za-z0-9]+", r"[^\W_]+"
#: An automaton holds at most so many passages; those of a longer list are spread over several.
BLOCK = 200_000
_built: dict[str, tuple] = {}


def words_of(text: str, word: str = ASCII_WORDS) -> list[str]:
    """The words of a text, in lower case."""
    return [w.lower() for w in re.findall(word, text)]


def passages(tests: DataFrame, size: int, word: str = ASCII_WORDS) -> DataFrame:
    """Every passage of ``size`` consecutive words of test items (item_id, text), made where the items lie: passage, items that hold it."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = set()
            for item, text in zip(pdf["item_id"], pdf["text"], strict=True):
                words = words_of(text, word)
                out.update((" ".join(words[i : i + size]), item) for i in range(len(words) - size + 1))
            yield pd.DataFrame(sorted(out), columns=["passage", "item_id"])

    rows = tests.dropna().mapInPandas(cut, "passage string, item_id long")
    return rows.groupBy("passage").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def build_automaton(block: list[tuple[str, list[int]]]) -> tuple[dict[str, str], Any]:
    """Words as single characters, and the Aho-Corasick automaton over the passages written so.

    A word is one character, so a match can't begin or end inside a word, and unknown words are
    character 0, which no passage holds.
    """
    import ahocorasick

    letters: dict[str, str] = {}
    automaton = ahocorasick.Automaton()
    for passage, ids in block:
        for w in passage.split(" "):
            if w not in letters:
                n = len(letters) + 1
                letters[w] = chr(n if n < 0xD800 else n + 0x800)
        automaton.add_word("".join(letters[w] for w in passage.split(" ")), tuple(ids))
    automaton.make_automaton()
    return letters, automaton


def _runs(ends: list[int], size: int) -> list[list[int]]:
    """Words covered by passages that end at ``ends`` (rising), as [first, one past the last] of longest runs."""
    runs: list[list[int]] = []
    for e in ends:
        if runs and e - size + 1 <= runs[-1][1]:
            runs[-1][1] = e + 1
        else:
            runs.append([e - size + 1, e + 1])
    return runs


def leaked(
    df: DataFrame, tests: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 12, word: str = ASCII_WORDS
) -> DataFrame:
    """Each stretch of a document that a test item shares: doc_id, item_id, n_words, start, end.

    The two share a passage if ``size`` consecutive words of one are consecutive words of the
    other, in lower case. A row is a longest run of the document's words that lie in shared
    passages of the item: ``n_words`` of them, between the character offsets ``start`` and ``end``
    of the document's own text. A document with two copies of an item has two rows. ``word`` is
    ``ASCII_WORDS`` or ``ALL_WORDS``. Null and shorter texts match nothing; an item shorter than
    ``size`` words can't be found; documents repeated under one id count once if their texts are
    equal and are kept apart if not; empty tables give no rows; other columns are dropped.

    Passages are made and gathered in the cluster. They are spread by their hash over automata of
    at most ``BLOCK`` passages, which are sent to the tasks one by one; the driver holds the
    passages of one automaton at a time. Each document is read once per automaton, whole, and is
    never shuffled. What several automata find of a document and item is united, so that the rows
    don't depend on ``BLOCK``.
    """
    spark = df.sparkSession
    listed = staged(passages(tests.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")), size, word), "passages")
    total = listed.count()
    # A hash fills its parts unevenly: they are planned at four fifths.
    shards = 1 if total <= BLOCK else -(-total * 5 // (BLOCK * 4))
    texts = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.length("text") >= 2 * size - 1)
    token = uuid.uuid4().hex

    def scanner(number: int, shared):
        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if not shared.value:
                return
            if (token, number) not in _built:  # once per worker, for all its tasks
                _built.clear()
                _built[token, number] = build_automaton(shared.value)
            letters, automaton = _built[token, number]
            look, pattern = letters.get, re.compile(word)
            for pdf in batches:
                found = []
                for doc, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                    words = pattern.findall(t)
                    if len(words) < size:
                        continue
                    coded = "".join([look(w.lower(), "\0") for w in words])
                    hits: dict[int, list[int]] = {}
                    for end, ids in automaton.iter(coded):
                        for item in ids:
                            hits.setdefault(item, []).append(end)
                    if not hits:
                        continue
                    spans = [m.span() for m in pattern.finditer(t)]
                    for item, ends in hits.items():
                        runs = [{"w": w, "w_end": e, "start": spans[w][0], "end": spans[e - 1][1]} for w, e in _runs(ends, size)]
                        found.append((doc, hash_of(t), item, runs))
                yield pd.DataFrame(found, columns=["doc_id", "copy", "item_id", "runs"])

        return scan

    out = None
    for number in range(shards):
        part = listed.where(F.pmod(F.xxhash64("passage"), F.lit(shards)) == number) if shards > 1 else listed
        shared = spark.sparkContext.broadcast(sorted((r[0], list(r[1])) for r in part.collect()))
        hit = texts.mapInPandas(scanner(number, shared), "doc_id long, copy long, item_id long, runs array<struct<w: int, w_end: int, start: long, end: long>>")
        out = hit if out is None else out.unionByName(hit)
    joined = out.groupBy("doc_id", "copy", "item_id").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"))
    spans = joined.select("doc_id", "item_id", F.explode(_united(F.col("runs"))).alias("r"))
    return spans.select("doc_id", "item_id", (F.col("r.w_end") - F.col("r.w")).cast("long").alias("n_words"), "r.start", "r.end")


def hash_of(text: str) -> int:
    """A number that tells texts under one id apart."""
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _united(runs):
    """Sorted runs with those that touch made one."""

    def step(done, r):
        last = F.element_at(done, -1)
        longer = F.struct(
            last["w"].alias("w"), F.greatest(last["w_end"], r["w_end"]).alias("w_end"), last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end")
        )
        apart = (F.size(done) == 0) | (r["w"] > F.try_element_at(done, F.lit(-1))["w_end"])
        rest = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(apart, F.concat(done, F.array(r))).otherwise(F.concat(rest, F.array(longer)))

    return F.aggregate(runs, F.slice(runs, 1, 1), step)
