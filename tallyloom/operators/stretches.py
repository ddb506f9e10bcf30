"""What look-back windows hold, for many series at once: numpy over rows that lie in order.

Rows come sorted by *group* (a subject's chunk of time, and a share of its codes): first the index times
of the group, then by code an optional row of older totals and the partials that reach into the chunk. All windows
are made from that one pass over the rows. A window of a code holds a range of its partials, and the range changes
only at index times where one has come in or gone out; between them stands a *stretch*. Counts and exact sums are
differences of running totals of whole numbers; least, greatest and sums of doubles are folded over doubling spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Kinds of rows.
INDEX, OLDER, PARTIAL, EARLIER = 0, 1, 2, 3
#: Rows are worked on in whole groups, together at least so many; times leave in lists of at most _PIECE, about _BATCH in a batch.
_LOAD, _PIECE, _BATCH = 100_000, 4096, 250_000
_EXACT, _NEVER = 2**53, 2**62


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before; the first does."""
    out = np.zeros(len(columns[0]), dtype=bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _numbers(column: pa.Array, fill: float | int) -> tuple[np.ndarray, int]:
    """Values, nulls filled, and the decimal places of whole numbers: int64 where they fit, else Python's integers; doubles have none."""
    missing = column.is_null().to_numpy(zero_copy_only=False)
    if not pa.types.is_decimal(column.type):
        return np.where(missing, fill, column.fill_null(0).to_numpy(zero_copy_only=False)), 0
    raw = np.frombuffer(column.buffers()[1], dtype="<i8")[2 * column.offset : 2 * (column.offset + len(column))].reshape(-1, 2)
    low, high = np.where(missing, 0, raw[:, 0]), np.where(missing, 0, raw[:, 1])
    if (high == low >> 63).all():
        return np.where(missing, fill, low), column.type.scale
    whole = [fill if m else (h << 64) + (x & 2**64 - 1) for x, h, m in zip(low.tolist(), high.tolist(), missing.tolist(), strict=True)]
    return np.array(whole, dtype=object), column.type.scale


def _doubles(values: np.ndarray, places: int) -> np.ndarray:
    """Whole numbers of units as the nearest doubles."""
    if values.dtype != object and (not len(values) or max(-int(values.min()), int(values.max())) < _EXACT):
        return values / float(10**places)
    return np.array([int(x) / 10**places for x in values.tolist()], dtype=float)


def _extreme(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, fold: Callable) -> np.ndarray:
    """``fold`` (least or greatest) of values[lo:hi], none empty: two spans of a power of two cover a range."""
    out, level, span = values[lo], np.frexp((hi - lo).astype(float))[1] - 1, 1
    for j in range(1, int(level.max(initial=0)) + 1):
        values, span = fold(values[:-span], values[span:]), 2 * span
        at = np.nonzero(level == j)[0]
        out[at] = fold(values[lo[at]], values[hi[at] - span])
    return out


def _total(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums of doubles values[lo:hi], none empty, of what lies in the range alone: spans by the bits of its length."""
    out, at, length, span = np.zeros(len(lo)), lo.copy(), hi - lo, 1
    while True:
        has = np.nonzero(length & span)[0]
        out[has] += values[at[has]]
        at[has] += span
        if not len(length) or 2 * span > length.max():
            return out
        values, span = values[:-span] + values[span:], 2 * span


def _difference(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums of whole numbers values[lo:hi]; exact, as Python's integers where 64 bits might not do."""
    if values.dtype != object and np.abs(values.astype(float)).sum() > 2**62:
        values = values.astype(object)
    running = np.concatenate([np.zeros(1, dtype=values.dtype), np.cumsum(values)])
    return running[hi] - running[lo]


def _aggregate(part: str, values: np.ndarray, places: int, lo: np.ndarray, hi: np.ndarray, none: np.ndarray) -> np.ndarray:
    """One partial of each range; where ``none`` has a value, it is to be made null."""
    if part in ("lo", "hi"):
        # As in Spark, NaN is greater than all others.
        least = np.fmin if values.dtype.kind == "f" else np.minimum
        out = _extreme(values, lo, hi, least if part == "lo" else np.maximum)
    elif values.dtype.kind == "f":
        return _total(values, lo, hi)
    else:
        out = _difference(values, lo, hi)
    if out.dtype.kind == "f" or part in ("n", "nv"):
        return out
    out[none] = 0
    return _doubles(out, places)


def _restore(parts: dict[str, tuple[np.ndarray, int]], alone: np.ndarray) -> None:
    """The sum, sum of squares and greatest value of a lone row, left out on the way, from its value."""
    value = parts["lo"][0][alone]
    whole = value.dtype.kind != "f"
    square = value.astype(object) ** 2 if whole and (np.abs(value.astype(float)) > 3e9).any() else value * value
    for part, own in (("s", value), ("ss", square), ("hi", value)):
        if part in parts:
            values, places = parts[part]
            values = values.astype(object) if own.dtype == object else values
            values[alone] = own
            parts[part] = values, places


def _fill(part: str, kind: pa.DataType) -> float | int:
    """Stands for no value: it changes no fold."""
    if part not in ("lo", "hi"):
        return 0
    if pa.types.is_decimal(kind):
        return 2**63 - 1 if part == "lo" else -(2**63)
    return np.nan if part == "lo" else -np.inf


def _batches(subject: np.ndarray, code: np.ndarray, names: pa.Array, window: str, values: dict[str, pa.Array], times: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Stretches with their index times as lists, cut to pieces and dealt into batches."""
    pieces = -(-(end - start) // _PIECE)
    of = np.repeat(np.arange(len(start)), pieces)
    first = start[of] + _PIECE * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    size = np.minimum(end[of] - first, _PIECE)
    cuts = np.nonzero(_changes(np.cumsum(size) // _BATCH))[0].tolist() if len(size) else []
    for at, to in zip(cuts, [*cuts[1:], len(of)], strict=True):
        own, n = of[at:to], size[at:to]
        offsets = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat(first[at:to] - offsets[:-1], n) + np.arange(offsets[-1])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(times[place]).cast(pa.timestamp("us")))
        taken = {name: column.take(pa.array(own)) for name, column in values.items()}
        yield pa.RecordBatch.from_pydict({"subject_id": pa.array(subject[own]), "code": names.take(pa.array(code[own])), "window": pa.array([window] * len(own), pa.string()), **taken, "_at": lists})


def _work(rows: pa.Table, sizes: dict[str, int | None], outputs: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """Stretches of whole groups."""
    column = {name: rows[name].combine_chunks() for name in rows.column_names}
    column = {name: pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for name, c in column.items()}
    subject, chunk, bucket, kind = (column[c].to_numpy(zero_copy_only=False) for c in ("subject_id", "_chunk", "_bucket", "_kind"))
    us = column["_us"].fill_null(0).to_numpy(zero_copy_only=False)
    group = np.cumsum(_changes(subject, chunk, bucket)) - 1
    is_index = kind == INDEX
    # Within a group times count from its least, so that all groups lie in one order, as many as 64 bits can hold.
    timed, first = kind != OLDER, np.nonzero(_changes(group))[0]
    least = np.minimum.reduceat(np.where(timed, us, _NEVER), first)
    span = max(1, *(np.maximum.reduceat(np.where(timed, us, -_NEVER), first) - least).tolist()) + max([s for s in sizes.values() if s is not None], default=0) + 1
    if span * len(first) > _NEVER and len(first) > 1:
        half = int(first[len(first) // 2])
        for part in (rows.slice(0, half), rows.slice(half)):
            yield from _work(part, sizes, outputs)
        return
    placed = group * span + np.where(timed, us - least[group], 0)
    times, at, of = us[is_index], placed[is_index], group[is_index]
    begin, stop = (np.searchsorted(of, np.arange(group[-1] + 1), side) for side in ("left", "right"))

    held = np.nonzero(~is_index)[0]
    if not len(held) or not len(times):
        return
    names = column["code"].take(pa.array(held)).dictionary_encode()
    code = names.indices.to_numpy(zero_copy_only=False)
    first = np.nonzero(_changes(group[held], code))[0]
    series = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(held))))
    s_group, s_code = group[held][first], code[first]
    s_subject, s_end = subject[held][first], stop[s_group]
    older, own = kind[held] == OLDER, kind[held] == PARTIAL
    came = np.where(older, begin[group[held]], np.searchsorted(at, placed[held]))
    many = len(times) + 1
    parts = {p: _numbers(column[p].take(pa.array(held)), _fill(p, column[p].type)) for p in dict.fromkeys(["n", "nv", *outputs.values()])}
    if "lo" in parts:
        _restore(parts, (parts["n"][0] == 1) & (parts["nv"][0] == 1))

    for window, size in sizes.items():
        chosen = np.nonzero(older | own if size is None else ~older)[0]
        k = series[chosen]
        comes = k * many + came[chosen]
        if size is None:
            points = comes[_changes(comes)]
            kp = points // many
            lo = np.searchsorted(k, kp)
        else:
            goes = k * many + np.searchsorted(at, placed[held[chosen]] + size)
            points = np.unique(np.concatenate([comes, goes]))
            kp = points // many
            lo = np.searchsorted(goes, points, "right")
        hi = np.searchsorted(comes, points, "right")
        start = points % many
        end = s_end[kp]
        same = kp[1:] == kp[:-1]
        end[:-1][same] = start[1:][same]
        keep = np.nonzero((hi > lo) & (end > start))[0]
        lo, hi, start, end, kp = lo[keep], hi[keep], start[keep], end[keep], kp[keep]
        none = _difference(parts["nv"][0][chosen], lo, hi) == 0
        values = {}
        for name, part in outputs.items():
            out = _aggregate(part, parts[part][0][chosen], parts[part][1], lo, hi, none)
            values[name] = pa.array(out) if part in ("n", "nv") else pa.array(out, mask=none, from_pandas=False)
        yield from _batches(s_subject[kp], s_code[kp], names.dictionary, window, values, times, start, end)


def stretches(sizes: dict[str, int | None], outputs: dict[str, str], load: int = _LOAD) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over rows in order of group: subject_id, code, window, the outputs (column: its partial) and ``_at``, the index times of a stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n, due = [], 0, load
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n >= due:
                rows = pa.Table.from_batches(waiting)
                last = int(np.nonzero(_changes(*(rows[c].to_numpy() for c in ("subject_id", "_chunk", "_bucket"))))[0][-1])
                if last:
                    yield from _work(rows.slice(0, last), sizes, outputs)
                rest = rows.slice(last)
                waiting, n = rest.to_batches(), len(rest)
                due = max(load, 2 * n)  # a group larger than a load is not searched again with every batch
        if n:
            yield from _work(pa.Table.from_batches(waiting), sizes, outputs)

    return run


def output_columns(outputs: Sequence[str]) -> str:
    """The rows that come out, as a schema."""
    return "subject_id long, code string, window string, " + ", ".join(f"{c} {'long' if c.endswith('count') else 'double'}" for c in outputs) + ", _at array<timestamp_ntz>"
