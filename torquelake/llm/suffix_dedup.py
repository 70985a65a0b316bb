"""Suffix-array deduplication by longest-previous-factor arrays: strings of 400 bytes.

Candidate regions that share a minimiser meet in one bucket (see ``repeats``). There

1. prefix doubling sorts all window starts by their suffixes, as far as 400 bytes;
2. for every start the previous and the next smaller position in suffix order are found, since one of
   the two has the longest common prefix with it among all earlier positions;
3. common prefixes with both, from the ranks of the doublings, give the longest-previous-factor array,
   capped at 400, and where each factor begins;
4. a start whose factor has 400 bytes is a later copy; one that is such a factor and has none itself is
   the first copy, which ``keep_first`` leaves.

Equal strings are merged before, with their count: all their starts are each other's factors. Small buckets are judged together:
equal windows have one minimiser, so none finds a copy in another bucket. In the buckets of minimisers that are too frequent to be gathered
(``repeats.HOT``) equal windows find each other by digest instead.

Defined results: a null text counts as empty; texts under 400 bytes lose nothing by themselves;
repeated rows are occurrences of each other; an empty table gives an empty result; other columns are
ignored; texts of any length are taken whole. Removal works on bytes, so what is left need not be valid UTF-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from torquelake.llm.repeats import Units, covered, repeated_spans

BYTES = Units("bytes", 400, 32, together=1 << 15)


def prefix_ranks(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(width, ranks of all positions by their first ``width`` bytes) for widths that double up to ``length``; zeros follow the end."""
    key = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):  # eight bytes in one number
        key = (key[:-width] << np.uint64(8 * width)) | key[width:]
    width = min(8, length)
    levels = [(width, _dense(key[: len(data)] >> np.uint64(8 * (8 - width))))]
    while width < length:
        step, rank = min(width, length - width), levels[-1][1]
        ahead = np.concatenate([rank[step:] + 1, np.zeros(step, np.int64)])[: len(rank)]
        width += step
        levels.append((width, _dense(rank * (int(rank.max()) + 2) + ahead)))
    return levels


def _dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    out = np.empty(len(key), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
    return out


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each index of different ``values`` the last index before it with a smaller value, or -1.

    All start from their neighbour; where that is larger, its own candidate comes next, since all between are larger still.
    """
    out = np.arange(-1, len(values) - 1)
    open_ = np.flatnonzero((out >= 0) & (values[out] > values)) if len(values) else out
    while len(open_):
        out[open_] = out[out[open_]]
        to = out[open_]
        open_ = open_[(to >= 0) & (values[to] > values[open_])]
    return out


def common_prefix(a: np.ndarray, b: np.ndarray, data: np.ndarray, levels: list[tuple[int, np.ndarray]], most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of suffixes, at most ``most``: from the widest level down, then by bytes."""
    n = len(data)
    out = np.zeros(len(a), np.int64)
    same = levels[-1][1][a] == levels[-1][1][b]
    out[same] = levels[-1][0]
    todo = np.flatnonzero(~same)
    for width, rank in reversed(levels[:-1]):
        x, y = a[todo] + out[todo], b[todo] + out[todo]
        hit = (np.maximum(x, y) < n) & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)])
        out[todo[hit]] += width
    for _ in range(levels[0][0] - 1):
        x, y = a[todo] + out[todo], b[todo] + out[todo]
        hit = (np.maximum(x, y) < n) & (data[np.minimum(x, n - 1)] == data[np.minimum(y, n - 1)])
        todo = todo[hit]
        out[todo] += 1
    return np.minimum(out, most)


def previous_factors(positions: np.ndarray, data: np.ndarray, length: int, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest-previous-factor array of the suffixes at rising ``positions``: lengths, and each factor's place in ``positions`` (-1: none).

    Lengths are capped at ``length`` and at ``room``, the bytes before the end of a position's string.
    """
    levels = prefix_ranks(data, length)
    order = np.argsort(levels[-1][1][positions], kind="stable")  # equal ones by rising position
    before = previous_smaller(order)
    after = previous_smaller(order[::-1])[::-1]
    after = np.where(after >= 0, len(order) - 1 - after, -1)
    best, factor = np.zeros(len(positions), np.int64), np.full(len(positions), -1)
    for near in (before, after):
        at = np.flatnonzero((near >= 0) & (best[order] < length))  # a full one can't be bettered
        mine, other = order[at], order[near[at]]
        size = common_prefix(positions[mine], positions[other], data, levels, np.minimum(np.minimum(room[mine], room[other]), length))
        better = size > best[mine]
        best[mine[better]], factor[mine[better]] = size[better], other[better]
    return best, factor


def longest_previous(strings: list[bytes], counts: list[int], k: int = BYTES.k) -> list[tuple[list[int], list[int]]]:
    """Offsets of windows that occur again in the bucket, and of those with no earlier holder.

    A window occurs again if it has a previous factor of ``k`` bytes, is one, or its string has copies.
    """
    lens = np.array([len(s) for s in strings])
    begin = np.cumsum(lens) - lens
    n = lens - k + 1
    offsets = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    starts = np.repeat(begin, n) + offsets
    size, factor = previous_factors(starts, np.frombuffer(b"".join(strings), np.uint8), k, np.repeat(lens, n) - offsets)
    later = size >= k
    repeated = later | np.repeat(np.array(counts) > 1, n)
    repeated[factor[later]] = True
    cuts = np.cumsum(n)[:-1]
    return [(o[r].tolist(), o[f].tolist()) for o, r, f in zip(np.split(offsets, cuts), np.split(repeated, cuts), np.split(repeated & ~later, cuts), strict=True)]


def remove_repeated_bytes(docs: DataFrame, keep_first: bool = False) -> DataFrame:
    """doc_id, kept bytes, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    spans = repeated_spans(docs, BYTES, longest_previous, keep_first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, total, removed, n_spans, sha = [], [], [], [], []
            for text, hits, firsts in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                raw = text.encode()
                gone = covered(len(raw), BYTES.k, hits, firsts) if hits else None
                left = raw if gone is None else np.frombuffer(raw, np.uint8)[~gone].tobytes()
                kept.append(left)
                total.append(len(raw))
                removed.append(len(raw) - len(left))
                n_spans.append(0 if gone is None else int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum()))
                sha.append(hashlib.sha256(left).hexdigest())
            cols = [b.column(0), pa.array(kept, pa.binary()), *(pa.array(c, pa.int64()) for c in (total, removed, n_spans)), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return spans.mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
