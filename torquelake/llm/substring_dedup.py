"""Substring deduplication by super-k-mer partitioning: windows of 35 words.

Consecutive windows with one minimiser travel as one packed string of words to its bucket, where the
windows are sorted and equal neighbours counted; see ``repeats`` for the stages.

Defined results: a null text counts as empty and loses nothing; texts with fewer than 35 words lose
nothing by themselves; repeated rows are occurrences of each other; an empty table gives an empty
result; a text of any length is handled whole, its words and hashes fitting a worker; other columns
are ignored, and carried ones are named inside their struct, so none can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from torquelake.llm.repeats import Units, covered, repeated_spans, word_spans

WORDS = Units("words", 35, 8)


def sort_and_count(strings: list[bytes], counts: list[int]) -> list[tuple[list[int], list[int]]]:
    """Offsets of windows that occur again in the bucket, and of those with no earlier holder."""
    every: list[list[int]] = [[] for _ in strings]
    lead: list[list[int]] = [[] for _ in strings]
    order = sorted((w, i, j) for i, s in enumerate(strings) for j, w in enumerate(WORDS.windows(s)))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and order[end][0] == order[at][0]:
            end += 1
        if end - at > 1 or counts[order[at][1]] > 1:
            for _, i, j in order[at:end]:
                every[i].append(j)
            lead[order[at][1]].append(order[at][2])
        at = end
    return [(sorted(e), sorted(f)) for e, f in zip(every, lead, strict=True)]


def cut_out(raw: bytes, gone: np.ndarray) -> bytes:
    """What is left of a text: its runs of kept words with their own white space, joined by one space."""
    starts, ends = word_spans(raw)
    edge = np.diff(np.concatenate([[0], (~gone).astype(np.int8), [0]]))
    return b" ".join(raw[starts[a] : ends[b - 1]] for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True))


def remove_repeated_windows(docs: DataFrame, keep_first: bool = False, carry: list[str] | None = None) -> DataFrame:
    """doc_id, kept_text, n_words, n_removed, kept_sha256 of every row, and its ``carry`` columns as one struct of that name.

    kept_text keeps the text's own white space between kept words; kept_sha256 is of the kept words
    joined by one space. With ``keep_first`` the first occurrence of each window stays.
    """
    spans = repeated_spans(docs, WORDS, sort_and_count, keep_first, carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, total, removed, sha = [], [], [], []
            for text, hits, firsts in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                raw = text.encode()
                w = raw.split()
                if hits:
                    gone = covered(len(w), WORDS.k, hits, firsts)
                    kept.append(cut_out(raw, gone).decode() if gone.any() else text)
                    removed.append(int(gone.sum()))
                    w = [x for x, g in zip(w, gone.tolist(), strict=True) if not g]
                else:
                    kept.append(text)
                    removed.append(0)
                total.append(len(w) + removed[-1])
                sha.append(hashlib.sha256(b" ".join(w)).hexdigest())
            cols = [b.column(0), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *([b.column(4)] if carry else [])], ["doc_id", "kept_text", "n_words", "n_removed", "kept_sha256", *(["carry"] if carry else [])])

    schema = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("kept_text", T.StringType()), ("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()))])
    if carry:
        schema.add(spans.schema["carry"])
    return spans.mapInArrow(run, schema)
