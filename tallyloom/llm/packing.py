"""Texts packed into containers of a fixed number of tokens: best-fit decreasing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.workspace import staged

#: A token: a longest run of ASCII letters, digits and _, or of other characters that are not ASCII white space.
TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\r\f\x0B]+"


def token_count(text: Column) -> Column:
    """Number of tokens of a text; null for null.

    Each run becomes one character and white space goes, so that a length counts the runs: three
    times as fast as extracting them.
    """
    words = F.regexp_replace(text, r"[A-Za-z0-9_]+", "a")
    runs = F.regexp_replace(words, r"[^a \t\n\r\f\x0B]+", "b")
    return F.length(F.translate(runs, " \t\n\r\f\x0b", "")).cast("long")


class OpenBins:
    """Open containers by remaining capacity, under a segment tree that finds the tightest fit.

    Leaf ``c`` of the tree counts the open containers with ``c`` tokens left, an inner node those
    of its range; the least capacity not under a size is found in one walk up and one down.
    """

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.nodes = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, left: int, number: int) -> None:
        self.bins[left].append(number)
        node = left + self.leaves
        while node:
            self.nodes[node] += 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove the tightest open container with room for ``size``: (its number, what was left)."""
        node = size + self.leaves
        if not self.nodes[node]:
            # Up to the first ancestor whose right sibling has a container, then down on the left.
            while node > 1 and (node & 1 or not self.nodes[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.nodes[2 * node] else 2 * node + 1
        left = node - self.leaves
        number = self.bins[left].pop()
        while node:
            self.nodes[node] -= 1
            node >>= 1
        return number, left


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each item; items go in by falling size, each into the tightest container with room."""
    out = np.empty(len(sizes), dtype=np.int64)
    bins, made = OpenBins(capacity), 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        found = bins.take(size)
        if found is None:
            number, left, made = made, capacity, made + 1
        else:
            number, left = found
        out[i] = number
        if left - size:
            bins.add(left - size, number)
    return out


#: What is packed: a piece of a text; ``copy``, a hash of the text, tells several texts under one id apart.
_ITEM = ["doc_id", "copy", "piece"]


def _pack_round(items: DataFrame, capacity: int, per_task: int, label: str) -> DataFrame:
    """One round: items spread by hash into groups of about ``per_task``, each packed on its own."""
    groups = max(1, -(-items.count() // per_task))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(_ITEM, kind="stable", ignore_index=True)
        numbers = best_fit_decreasing(pdf["n_tokens"].to_numpy(), capacity)
        pdf["container"] = [f"{label}-{g}-{n}" for g, n in zip(pdf["group"], numbers, strict=True)]
        pdf["filled"] = pd.Series(pdf["n_tokens"].to_numpy()).groupby(numbers).transform("sum").to_numpy()
        return pdf[[*_ITEM, "start_token", "n_tokens", "container", "filled"]]

    schema = "doc_id long, copy long, piece int, start_token long, n_tokens long, container string, filled long"
    return items.withColumn("group", F.pmod(F.xxhash64(*_ITEM), F.lit(groups))).groupBy("group").applyInPandas(pack, schema)


def pack_texts(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, per_task: int = 50_000, full: float = 0.98
) -> DataFrame:
    """Containers of at most ``capacity`` tokens: doc_id, copy, piece, n_pieces, start_token, n_tokens, container.

    Each text stays whole unless it has more than ``capacity`` tokens; such a text is cut into
    full pieces and a rest. Null texts and texts without tokens take no space and get no row.
    Rows that agree in id and text are one item; several texts under one id are all packed, each
    with a ``copy`` of its own (a hash of the text). Rows without an id get no row, and other
    columns are dropped.

    Only ids and sizes are shuffled, never texts. Groups of about ``per_task`` items, chosen by
    hash, are packed each in a task; containers less than ``full`` filled are opened again and
    their items packed once more together with those of other groups, so that at any size the
    unfilled containers are few.
    """
    texts = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("copy"), token_count(F.col(text)).alias("tokens"))
    sizes = texts.where("tokens > 0 and doc_id is not null").dropDuplicates(["doc_id", "copy"])
    n = F.ceil(F.col("tokens") / capacity).cast("int")
    pieces = sizes.select("doc_id", "copy", "tokens", n.alias("n_pieces"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece")).select(
        *_ITEM, (F.col("piece") * F.lit(capacity)).cast("long").alias("start_token"),
        F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity).cast("long").alias("n_tokens"), "n_pieces",
    )
    pieces = staged(pieces, "pieces")
    whole = pieces.where(F.col("n_tokens") == capacity)
    done = whole.select(*_ITEM, "start_token", "n_tokens", F.concat_ws("-", F.lit("f"), *_ITEM).alias("container"))
    first = staged(_pack_round(pieces.where(F.col("n_tokens") < capacity).drop("n_pieces"), capacity, per_task, "a"), "packed")
    good = F.col("filled") >= int(full * capacity)
    again = first.where(~good).select(*_ITEM, "start_token", "n_tokens")
    second = _pack_round(again, capacity, per_task, "b")
    packed = done.unionByName(first.where(good).drop("filled")).unionByName(second.drop("filled"))
    many = pieces.where("piece = 0 and n_pieces > 1").select("doc_id", "copy", "n_pieces")
    return packed.join(many, ["doc_id", "copy"], "left").select(
        *_ITEM, F.coalesce("n_pieces", F.lit(1)).alias("n_pieces"), "start_token", "n_tokens", "container"
    )


def split_texts(packed: DataFrame) -> DataFrame:
    """Ids of the texts that lie in more than one container: doc_id."""
    lies = packed.groupBy("doc_id", "copy").agg(F.min("container").alias("a"), F.max("container").alias("b"))
    return lies.where("a <> b").select("doc_id").distinct()


def containers(packed: DataFrame) -> DataFrame:
    """What each container holds: container, n_pieces, filled (tokens)."""
    return packed.groupBy("container").agg(F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("filled"))


def piece_texts(df: DataFrame, packed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The packed pieces with their texts: whole texts as they are, pieces from their first token to the next piece's.

    The pieces of a text joined in order give the text back.
    """
    cut = re.compile(TOKEN.replace(r"\x0B", r"\x0b"))

    def slice_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t, start, n, pieces in zip(pdf["text"], pdf["start_token"], pdf["n_tokens"], pdf["n_pieces"], strict=True):
                if pieces == 1:
                    out.append(t)
                    continue
                begin, end = 0 if start == 0 else None, len(t)
                for i, m in enumerate(cut.finditer(t)):
                    if i == start and begin is None:
                        begin = m.start()
                    if i == start + n:
                        end = m.start()
                        break
                out.append(t[begin:end])
            yield pdf.assign(text=out)[["container", *_ITEM, "text"]]

    texts = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("copy"), F.col(text).alias("text")).dropDuplicates(["doc_id", "copy"])
    return texts.join(packed, ["doc_id", "copy"]).mapInPandas(slice_texts, "container string, doc_id long, copy long, piece int, text string")
