"""Vector bin packing of token sequences by the dot-product heuristic.

A sequence has three limits at once: tokens, segments (pieces) and loss-bearing tokens. Into an
open sequence goes, of the pieces at hand that fit every limit, the one whose demand vector has the
largest dot product with what is left of the limits. When nothing fits, the largest piece is cut to
fill the rest. Each task packs the documents of its own partition from a bounded pool, so texts are not
shuffled, memory does not grow with the input, and a task that runs again makes the same pieces. What is
left in a task's pool at its end (at most ``POOL`` pieces, with their ids) goes with what other tasks left
to a second packing step, whose tasks are as many as these pieces fill, in a fixed order; so padding does
not follow the number of partitions.

Loss-bearing: every id but a document's first, which nothing precedes.

Defined results: a null text has no ids but the end id; repeated rows are packed each; a null
doc_id is kept; texts of any length are cut into as many pieces as they need; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torquelake.llm.common import materialize, tune

#: Tokens that each task of the second step packs, about.
SECOND = 1 << 20
#: Limits of a sequence, the pieces a task has at hand, and the shortest piece worth a cut. A sequence of
#: few long pieces meets LOSS first, one of many short documents SEGMENTS, the others TOKENS.
TOKENS, SEGMENTS, LOSS, POOL, MIN_CUT = 2048, 10, 2045, 256, 24

_WORDS = re.compile(r"[a-zß-öø-ÿ]+|[^ \n\ta-zß-öø-ÿ0-9]+|[0-9]")
#: Texts of these characters only can be split before the tokenizer without a change of ids.
_PLAIN = re.compile(r"[ \n\t!-&(-~À-ÖØ-öø-ÿ]*\Z")


class Ids:
    """Token ids of whole texts, with a bounded memory of words seen.

    This vocabulary splits text at white space and between letters, digits and marks, and ends each
    such piece with a token that carries the end mark. Plain texts (no apostrophe, special token or
    character that normalisation could change) are therefore split first and each distinct piece is
    looked up; the tokenizer encodes unseen pieces in one call. All other texts go to it whole.
    """

    KEEP = 1_000_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[v for k, v in vocab.items() if k.endswith("</w>")]] = True
        self.seen: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(new):
            raise ValueError("the vocabulary does not mark the end of each piece")
        raw, at = ids.tobytes(), 0
        for w, c in zip(new, (cuts * 4).tolist(), strict=True):
            self.seen[w] = raw[at:c]
            at = c

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        # Only between batches, so that no piece a batch has looked up is forgotten before its end.
        if len(self.seen) > self.KEEP:
            self.seen.clear()
        out: list = [b""] * len(texts)
        unseen: list[tuple[list, int, str]] = []
        gc.disable()  # millions of short-lived references, no cycles
        for k, t in enumerate(texts):
            if _PLAIN.match(t) and "<|" not in t:
                words = _WORDS.findall(t.lower())
                out[k] = parts = list(map(self.seen.get, words))
                if None in parts:
                    unseen += [(parts, i, words[i]) for i, p in enumerate(parts) if p is None]
            else:
                out[k] = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()]
        if unseen:
            self._learn(list({w for _, _, w in unseen}))
        for parts, i, w in unseen:
            parts[i] = self.seen[w]
        gc.enable()
        return [b"".join(p) for p in out]


_loaded: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    if path not in _loaded:
        _loaded[path] = Ids(path)
    return _loaded[path]


class Packer:
    """Packs (payload, tokens, loss) items into sequences; ``take(payload, n)`` cuts n tokens off a payload."""

    def __init__(self, take, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, pool: int = POOL):
        self.take, self.limits = take, np.array([tokens, segments, loss], float)
        self.demand = np.zeros((pool, 3))
        self.items: list = [None] * pool
        self.free = list(range(pool))
        self.sequence = 0

    def add(self, item, tokens: int, loss: int) -> Iterator[tuple]:
        """Put one item in the pool; yields placements (item, sequence, offset) when the pool is full."""
        while tokens >= self.limits[0]:  # whole sequences of one piece
            n = int(min(self.limits[0], self.limits[2]))
            head, item, lost = self.take(item, n)
            yield head, self.sequence, 0
            self.sequence += 1
            tokens -= n
            loss -= lost
            if not tokens:
                return
        while not self.free:
            yield from self.fill()
        k = self.free.pop()
        self.items[k], self.demand[k] = item, (tokens, 1, loss)

    def fill(self) -> Iterator[tuple]:
        """Fill one sequence from the pool."""
        left, offset = self.limits.copy(), 0
        while True:
            fits = (self.demand <= left).all(axis=1) & (self.demand[:, 0] > 0)
            if fits.any():
                score = (self.demand / self.limits) @ (left / self.limits)
                score[~fits] = -1
                k = int(score.argmax())
                yield self.items[k], self.sequence, offset
                offset += int(self.demand[k, 0])
                left -= self.demand[k]
                self.items[k], self.demand[k] = None, 0
                self.free.append(k)
                continue
            room = int(min(left[0], left[2]))
            k = int(self.demand[:, 0].argmax())
            if self.demand[k, 0] > 0 and left[1] >= 1 and (room >= MIN_CUT or offset == 0):
                head, rest, lost = self.take(self.items[k], room)
                yield head, self.sequence, offset
                self.items[k] = rest
                self.demand[k] -= (room, 0, lost)
            self.sequence += 1
            return

    def left(self) -> list:
        """The items in the pool."""
        return [i for i in self.items if i is not None]

    def close(self) -> Iterator[tuple]:
        while (self.demand[:, 0] > 0).any():
            yield from self.fill()


def _cut(piece: tuple, n: int) -> tuple[tuple, tuple, int]:
    """(doc_id, start, ids, doc_tokens) -> its first n ids, the rest, and the loss-bearing ids cut off."""
    doc, start, ids, total = piece
    return (doc, start, ids[: 4 * n], total), (doc, start + n, ids[4 * n :], total), n - (start == 0)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: What the first step makes: placed pieces, and with a null sequence_id and their ids those left over.
PIECES = f"{SCHEMA}, ids binary, task int, left int"


def _batch(placed: list[tuple], base: int, with_ids: bool, left: list[tuple] = (), task: int = 0) -> pa.RecordBatch:
    pieces = [p for p, _, _ in placed] + list(left)
    n, k = len(placed), len(left)
    numbers = [
        [p[0] for p in pieces], [p[1] for p in pieces], [len(p[2]) // 4 for p in pieces], [zlib.crc32(p[2]) for p in pieces], [p[3] for p in pieces],
        [base + s for _, s, _ in placed] + [None] * k, [o for _, _, o in placed] + [None] * k,
    ]
    ids = [p[2] if with_ids else None for p, _, _ in placed] + [p[2] for p in left]
    cols = [*(pa.array(v, pa.int64()) for v in numbers), pa.array(ids, pa.binary()), pa.array([task] * (n + k), pa.int32()), pa.array([None] * n + list(range(k)), pa.int32())]
    return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in PIECES.split(", ")])


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, with_ids: bool = False) -> DataFrame:
    """Tokenize every text of ``docs`` and pack the pieces; ``with_ids`` adds each piece's ids as little-endian unsigned 32-bit integers."""
    tune(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, task = ids_of(vocabulary), TaskContext.get().partitionId()
        packer = Packer(_cut, tokens, segments, loss)
        for b in batches:
            done: list[tuple] = []
            texts = [t or "" for t in b.column(1).to_pylist()]
            for doc, raw in zip(b.column(0).to_pylist(), ids.encode(texts), strict=True):
                raw += end
                n = len(raw) // 4
                done += packer.add((doc, 0, raw, n), n, n - 1)
            if done:
                yield _batch(done, task << 40, with_ids)
        if left := packer.left():
            yield _batch([], 0, with_ids, left, task)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (1 << 62) + (TaskContext.get().partitionId() << 40)
        packer = Packer(_cut, tokens, segments, loss)
        for b in batches:
            done = []
            for piece in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
                n = len(piece[2]) // 4
                done += packer.add(piece, n, n - (piece[1] == 0))
            if done:
                yield _batch(done, base, with_ids)
        if done := list(packer.close()):
            yield _batch(done, base, with_ids)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    pieces = materialize(rows.mapInArrow(first, PIECES), "pieces")
    over = pieces.where("sequence_id IS NULL")
    tasks = 1 + (over.agg(F.sum("length")).first()[0] or 0) // SECOND
    spread = over.repartition(tasks, F.xxhash64("task", "left")).sortWithinPartitions("task", "left")
    out = pieces.where("sequence_id IS NOT NULL").unionByName(spread.mapInArrow(second, PIECES))
    return out.select(*[c.split()[0] for c in SCHEMA.split(", ")], *(["ids"] if with_ids else []))
