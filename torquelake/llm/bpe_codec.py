"""Byte-level BPE encoding and decoding by speculation and verification.

A text is split into words as the vocabulary's pre-tokenizer does. For each word not met before

1. greedy longest match proposes tokens (speculation);
2. all adjacent pairs of all proposals are tested at once in numpy: a pair is compatible if merging the
   bytes of its two tokens by rank never joins something across the border between them. A sequence whose
   tokens are each their own encoding and whose adjacent pairs are all compatible is the encoding;
3. only words with an incompatible pair are merged exactly, lowest rank first.

Decoding joins the bytes of the ids; bytes that are no UTF-8 become U+FFFD.

Words found are remembered in each worker up to a bound that forgets between blocks of texts, so no result
depends on it. Nothing is shuffled: every task encodes its own rows.

Defined results: a null text has no ids and decodes to the empty text; special tokens written out in a text
are that token; repeated rows are encoded each; texts and words of any length are taken whole; a null
doc_id is kept; an empty table gives an empty result; in the query other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torquelake.llm.common import tune

#: Characters that the two rules below split as the pre-tokenizer does, whatever version of Unicode it has.
_PLAIN = re.compile(r"[\t\n\r -~¡-ɏ]*\Z")
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
_WORDS = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^\t\n\r {_L}{_N}]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+")
#: Characters of a block of texts whose new words are proposed and verified together.
BLOCK = 1 << 20
_NEVER = np.int64(1 << 40)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files of this kind: printable ones stand for themselves."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encodes and decodes with one vocabulary file of the ``tokenizers`` library."""

    #: Words a worker remembers, and the longest word (bytes) that is merged together with others.
    KEEP, SHORT = 1_000_000, 128

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, kind = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True) or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        alphabet = byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.bytes_of: list[bytes] = [b""] * size
        for token, k in vocab.items():
            self.bytes_of[k] = bytes(map(alphabet.__getitem__, token))
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, k in special.items():
            self.bytes_of[k] = content.encode()
        self.special = {c: np.array([k], "<u4").tobytes() for c, k in special.items()}
        self._special_split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        parts = np.array([(vocab[a], vocab[b]) for a, b in pairs], np.int64).reshape(-1, 2)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        #: By id: the rank of the merge that makes it (-1: a byte) and its two parts.
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.arange(size), np.arange(size)
        self.rank[made], self.left[made], self.right[made] = np.arange(len(made)), parts[:, 0], parts[:, 1]
        if len(set(made.tolist())) != len(made) or (self.rank[parts].max(axis=1, initial=-1) >= np.arange(len(made))).any():
            raise ValueError("each token must have one merge, after those of its parts")
        keys = parts[:, 0] * size + parts[:, 1]
        self._order = np.argsort(keys)
        self._keys = np.append(keys[self._order], np.iinfo(np.int64).max)
        self._size = size
        self._merge = dict(zip(map(tuple, parts.tolist()), zip(range(len(made)), made.tolist(), strict=True), strict=True))
        self._made = made
        self._byte = np.zeros(256, np.int64)
        self._byte[[self.bytes_of[k][0] for k in vocab.values() if len(self.bytes_of[k]) == 1]] = [k for k in vocab.values() if len(self.bytes_of[k]) == 1]

        # A token takes part in proposals only if its own bytes are encoded as that token.
        own = np.ones(size, bool)
        own[made] = self.compatible(parts[:, 0], parts[:, 1], np.arange(len(made)))
        for k, (a, b) in zip(made.tolist(), parts.tolist(), strict=True):
            own[k] &= own[a] & own[b]
        self._ids = {self.bytes_of[k]: k for k in vocab.values() if own[k]}
        #: The longest token by its first three bytes.
        self._longest: dict[bytes, int] = {}
        for t in self._ids:
            if len(t) > 2:
                self._longest[t[:3]] = max(len(t), self._longest.get(t[:3], 0))
        self.seen: dict[str, bytes] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of merging each pair, or _NEVER."""
        keys = left * self._size + right
        at = np.searchsorted(self._keys, keys)
        return np.where(self._keys[at] == keys, self._order[np.minimum(at, len(self._order) - 1)], _NEVER) if len(self._order) else np.full(len(keys), _NEVER)

    def compatible(self, left: np.ndarray, right: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether each pair's border survives the merges of its bytes (those of a rank under ``before`` only, if given).

        Goes back in time over the tokens that touch the border. The two at hand stood there until the next merge
        on either side, whose rank is the limit: had they a merge of a lower rank, it would have come first. Of equal
        ranks the leftmost merge comes first.
        """
        left, right = np.asarray(left, np.int64), np.asarray(right, np.int64)
        out, at = np.ones(len(left), bool), np.arange(len(left))
        limit = np.full(len(left), _NEVER) if before is None else np.asarray(before, np.int64)
        while len(at):
            crossed = self._ranks(left, right) < limit
            out[at[crossed]] = False
            of_left, of_right = self.rank[left], self.rank[right]
            go = ~crossed & ((of_left >= 0) | (of_right >= 0))
            at, left, right, of_left, of_right = at[go], left[go], right[go], of_left[go], of_right[go]
            undo_left = of_left > of_right
            limit = np.where(undo_left, of_left, of_right + 1)
            left, right = np.where(undo_left, self.right[left], left), np.where(undo_left, right, self.left[right])
        return out

    def propose(self, word: bytes) -> list[int]:
        """Tokens of ``word`` by greedy longest match."""
        ids, longest, out, i, n = self._ids, self._longest, [], 0, len(word)
        while i < n:
            j = i + longest.get(word[i : i + 3], 2)
            while (k := ids.get(word[i:j])) is None:
                j -= 1
            out.append(k)
            i += len(self.bytes_of[k])
        return out

    def merge(self, word: bytes) -> list[int]:
        """Tokens of one word by merging the pair of lowest rank, leftmost first, until none is left: n log n steps."""
        ids: list = self._byte[np.frombuffer(word, np.uint8)].tolist()
        after, ahead = [*range(1, len(ids)), -1], list(range(-1, len(ids) - 1))
        merge = self._merge
        heap = [(merge[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in merge]  # noqa: B905
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # one of the two is part of another token by now
            ids[i], ids[j], after[i] = merge[a, b][1], None, after[j]
            if after[i] >= 0:
                ahead[after[i]] = i
            for x, y in ((ahead[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (p := (ids[x], ids[y])) in merge:
                    heapq.heappush(heap, (merge[p][0], x, *p))
        return [k for k in ids if k is not None]

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Ids of many words by exact merging. In each round every word merges its pair of lowest rank, wherever it has it."""
        out: list[bytes] = [b""] * len(words)
        for k, w in enumerate(words):
            if len(w) > self.SHORT:
                out[k] = np.array(self.merge(w), "<u4").tobytes()
        short = [k for k, w in enumerate(words) if 0 < len(w) <= self.SHORT]
        word = np.repeat(np.array(short, np.int64), [len(words[k]) for k in short])
        ids = self._byte[np.frombuffer(b"".join(words[k] for k in short), np.uint8)]
        rank = self._pair_ranks(ids, word, np.arange(len(ids)))
        while len(ids):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(ids)])
            least = np.minimum.reduceat(rank, starts)
            done = least == _NEVER
            if done.any():
                tokens = ids.astype("<u4").tobytes()
                for k, a, n in zip(word[starts[done]].tolist(), starts[done].tolist(), sizes[done].tolist(), strict=True):
                    out[k] = tokens[4 * a : 4 * (a + n)]
                going = np.repeat(~done, sizes)
                ids, word, rank, least, sizes = ids[going], word[going], rank[going], least[~done], sizes[~done]
                if not len(ids):
                    break
            hit = rank == np.repeat(least, sizes)
            # In a run of overlapping pairs (aaaa) the first, third and so on are merged.
            place = np.arange(len(ids))
            run = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], place, 0))
            hit &= (place - run) % 2 == 0
            first = np.flatnonzero(hit)
            ids[first] = self._made[rank[first]]
            stays = np.ones(len(ids), bool)
            stays[first + 1] = False
            ids, word, rank = ids[stays], word[stays], rank[stays]
            at = first - np.arange(len(first))  # where the new tokens are now
            changed = np.unique(np.r_[at, at[at > 0] - 1])
            rank[changed] = self._pair_ranks(ids, word, changed)
        return out

    def _pair_ranks(self, ids: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The ranks of the pairs that begin at ``at``; none across the end of a word."""
        if not len(ids):
            return np.zeros(0, np.int64)
        after = np.minimum(at + 1, len(ids) - 1)
        return np.where((after > at) & (word[after] == word[at]), self._ranks(ids[at], ids[after]), _NEVER)

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        proposals = [self.propose(w) for w in raw]
        sizes = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter((k for p in proposals for k in p), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        inside = np.ones(len(flat), bool)
        inside[ends - 1] = False
        firsts = np.flatnonzero(inside)
        bad = firsts[~self.compatible(flat[firsts], flat[firsts + 1])]
        failing = np.unique(np.searchsorted(ends, bad, side="right")).tolist()
        tokens = flat.astype("<u4").tobytes()
        for w, end, n in zip(words, ends.tolist(), sizes.tolist(), strict=True):
            self.seen[w] = tokens[4 * (end - n) : 4 * end]
        self.seen.update(zip((words[k] for k in failing), self.merge_all([raw[k] for k in failing]), strict=True))

    def words(self, text: str) -> list[str]:
        if _PLAIN.match(text):
            return _WORDS.findall(text)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def _encode_block(self, texts: list[str]) -> list[bytes]:
        if len(self.seen) > self.KEEP:  # between blocks only, so that nothing a block has looked up is forgotten
            self.seen.clear()
        pieces: list[list[str]] = []
        for t in texts:
            cut = self._special_split.split(t) if self._special_split else [t]
            pieces.append(self.words(t) if len(cut) == 1 else [w for c in cut if c for w in ([c] if c in self.special else self.words(c))])
        seen = self.seen
        found = [list(map(seen.get, p)) for p in pieces]
        new = {w for p, f in zip(pieces, found, strict=True) if None in f for w, k in zip(p, f, strict=True) if k is None}
        seen.update({w: self.special[w] for w in new & self.special.keys()})
        if new := [w for w in new if w not in self.special]:
            self._learn(new)
        return [b"".join(map(seen.__getitem__, p) if None in f else f) for p, f in zip(pieces, found, strict=True)]

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        block: list[str] = []
        held = 0
        for t in texts:
            block.append(t)
            held += len(t)
            if held >= BLOCK:
                out += self._encode_block(block)
                block, held = [], 0
        return out + self._encode_block(block)

    def decode(self, ids: bytes) -> str:
        """The text of little-endian unsigned 32-bit ids."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_loaded: dict[str, Codec] = {}


def codec_of(path: str) -> Codec:
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def _add(df: DataFrame, source: str, made: dict[str, str], fill) -> DataFrame:
    """``df`` and the columns ``made`` (name to type), which ``fill`` computes from the values of column ``source``."""
    tune(df.sparkSession)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{source}`").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *fill(b.column(1).to_pylist())], ["row", *made])

    types = ", ".join(f"`{k}` {v}" for k, v in made.items())
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {types}")


def _rows_with(out: DataFrame, columns: list[str], made: dict) -> DataFrame:
    return out.select(*[F.col("row")[c].alias(c) for c in columns if c not in made], *made)


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each text, little-endian unsigned 32-bit, in column ``ids`` (binary; replaces one of that name)."""
    return _rows_with(_add(docs, text, {ids: "binary"}, lambda v: [pa.array(codec_of(vocabulary).encode(t or "" for t in v), pa.binary())]), docs.columns, {ids: None})


def decode(rows: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text of each row's ids in column ``text`` (replaces one of that name)."""
    return _rows_with(_add(rows, ids, {text: "string"}, lambda v: [pa.array([codec_of(vocabulary).decode(x or b"") for x in v], pa.string())]), rows.columns, {text: None})


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids and decoded text of every row of ``docs``, in one pass over the workers."""

    def both(values: list) -> list:
        codec = codec_of(vocabulary)
        ids = codec.encode(t or "" for t in values)
        return [pa.array(ids, pa.binary()), pa.array(map(codec.decode, ids), pa.string())]

    slim = docs.select("doc_id", "text")
    out = _add(slim.select("doc_id", "text"), "text", {"ids": "binary", "decoded": "string"}, both)
    return out.select(F.col("row.doc_id").alias("doc_id"), "ids", "decoded")
