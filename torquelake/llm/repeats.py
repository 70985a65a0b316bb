"""Exact repeated windows over a corpus by super-k-mer partitioning, for words and for bytes.

A window is ``k`` consecutive units (words or bytes) of one text. Its minimiser is the m-unit run
with the smallest hash in it; equal windows have equal minimisers, and consecutive windows mostly
share theirs, so they travel together as one super-k-mer.

1. Each text is cut into super-k-mers; only (minimiser hash, row, start, count) is written.
2. A minimiser that occurs once in the corpus cannot lie in a repeated window. Hashes are counted
   with partial aggregation and joined back; what is left is gathered by row.
3. Those rows, joined with their texts, pack each remaining super-k-mer as one string.
4. Equal strings are merged with their counts (partial aggregation, so a large group of copies is
   one row) and go to their minimiser's bucket, where windows are compared exactly. Buckets of a
   minimiser with more than ``HOT`` occurrences are not gathered: their windows are counted one by
   one under a 128-bit digest, which spreads them and merges equal ones before the shuffle.
5. Repeated windows return to their rows; each text is handled once more with its own spans.

No step gathers a group that can grow with the corpus: a row's spans are bounded by its own text.

Rows are told apart by (doc_id, hash of doc_id and text); repeated rows count as occurrences each.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torquelake.llm.common import discard, materialize, release, text_or_empty, tune

HOT = 4096
#: Units handled at once in a worker; longer texts are cut with an overlap of k - 1.
CHUNK = 1 << 19
#: Bytes hashed at once. Words of more than LONG bytes are named by a digest.
PIECE, LONG = 1 << 18, 64

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**64, 256, np.uint64)
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_LONG = re.compile(rb"[^\x20\x09-\x0D]{%d,}" % (LONG + 1))
_LONG_OR_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of ``raw``."""
    b = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~_SPACE[b]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A text in pieces of about PIECE bytes, cut after white space."""
    at = 0
    while at < len(raw):
        end = at + PIECE
        if end < len(raw):
            found = _GAP.search(raw, end)
            end = found.end() if found else len(raw)
        yield raw[at:end]
        at = end


def _hashed(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words of ``buf`` and their hashes: differences of a running polynomial sum, exact digests for long words."""
    if len(buf) > 4 * PIECE:  # holds a word of that size: digest such words first, and hash stand-ins of one byte
        long = [xxhash.xxh3_64_intdigest(m) for m in _LONG.findall(buf)]
        starts, h = _hashed(_LONG.sub(b"\0", buf))
        where = [m.start() for m in _LONG_OR_WORD.finditer(buf)]
        h[[i for i, m in enumerate(_LONG_OR_WORD.finditer(buf)) if len(m[0]) > LONG]] = long
        return np.array(where), h
    starts, ends = word_spans(buf)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    powers, inverse = _powers(len(buf))
    run = _BYTE[np.frombuffer(buf, np.uint8)]
    run *= powers[: len(buf)]
    np.cumsum(run, out=run)
    h = run[ends - 1]
    h -= np.where(starts > 0, run[starts - 1], np.uint64(0))
    h = mix(h * inverse[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG):
        h[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]])
    return starts, h


_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if not _tables or len(_tables[0]) < n:
        base, size = 0x9E3779B97F4A7C15, max(n, 2 * PIECE)
        _tables[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, v, np.uint64)])) for v in (base, pow(base, -1, 1 << 64))]
    return _tables[0], _tables[1]


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and each text's number of words. Texts are handled many at a time."""
    out, counts = [np.zeros(0, np.uint64)], np.zeros(len(raws), np.int64)
    held: list[bytes] = []
    own: list[int] = []

    def flush() -> None:
        begin = np.cumsum([0] + [len(p) + 1 for p in held])
        starts, h = _hashed(b" ".join(held))
        np.add.at(counts, own, np.diff(np.searchsorted(starts, begin)))
        out.append(h)
        held.clear()
        own.clear()

    size = 0
    for i, raw in enumerate(raws):
        for piece in _pieces(raw):
            held.append(piece)
            own.append(i)
            size += len(piece)
            if size >= PIECE:
                flush()
                size = 0
    if held:
        flush()
    return np.concatenate(out), counts


def byte_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return _BYTE[np.frombuffer(b"".join(raws), np.uint8)], np.array([len(r) for r in raws], np.int64)


@dataclass(frozen=True)
class Units:
    """What a window is made of: its length k, the minimiser's length (a power of two), and how a text is hashed.

    Buckets are judged together until they hold ``together`` bytes; equal windows are in one bucket, so the results are the same.
    """

    name: str
    k: int
    m: int
    together: int = 0

    def hashes(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all units of the texts, and each text's number of units."""
        return word_hashes(raws) if self.name == "words" else byte_hashes(raws)

    def pack(self, raw: bytes, starts: list[int], counts: list[int]) -> list[bytes]:
        """The packed string of each super-k-mer: its units, words joined by one space."""
        if self.name == "words":
            w = raw.split()
            return [b" ".join(w[s : s + n + self.k - 1]) for s, n in zip(starts, counts, strict=True)]
        return [raw[s : s + n + self.k - 1] for s, n in zip(starts, counts, strict=True)]

    def windows(self, packed: bytes) -> list[bytes]:
        if self.name == "words":
            at = [0]
            while (p := packed.find(b" ", at[-1])) >= 0:
                at.append(p + 1)
            at.append(len(packed) + 1)
            return [packed[at[i] : at[i + self.k] - 1] for i in range(len(at) - self.k)]
        return [packed[i : i + self.k] for i in range(len(packed) - self.k + 1)]


def superkmers(h: np.ndarray, owner: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimiser over units with hashes ``h``: (minimiser hash, first unit, windows).

    ``owner`` tells which text a unit belongs to; windows do not cross texts.
    """
    n = len(h) - k + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return np.zeros(0, np.uint64), empty, empty
    g, width = h, 1
    while width < m:  # hash of ``width`` units by doubling
        g = mix(g[:-width] * np.uint64(0x9E3779B97F4A7C15) + g[width:])
        width *= 2
    if m == 1:
        g = mix(g)
    # 40 bits of the hash and the place: the smallest of a span is its leftmost smallest hash.
    key = (g & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(g), dtype=np.uint64)
    span, width = k - m + 1, 1
    while width * 2 <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < span:
        key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
    place = (key[:n] & np.uint64(0xFFFFFF)).astype(np.int64)
    valid = owner[:n] == owner[k - 1 : k - 1 + n]
    at = np.flatnonzero(valid)
    if not len(at):
        return np.zeros(0, np.uint64), empty, empty
    place = place[at]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(at) != 1)]))
    return g[place[first]], at[first], np.diff(np.append(first, len(at)))


def cut(texts: list[bytes], units: Units) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, minimiser hash, first unit in the text, windows) of all super-k-mers, chunk by chunk."""
    group: list[int] = []
    size = 0
    for i, raw in enumerate(texts):
        group.append(i)
        size += len(raw)
        if size >= CHUNK or i == len(texts) - 1:
            h, counts = units.hashes([texts[j] for j in group])
            owner, begin = np.repeat(np.array(group), counts), np.cumsum(counts) - counts
            for s in range(0, max(1, len(h) - units.k + 1), CHUNK):
                part = slice(s, s + CHUNK + units.k - 1)
                mh, at, n = superkmers(h[part], owner[part], units.k, units.m)
                own = owner[part][at]
                yield own, mh, at + s - begin[own - group[0]], n
            group, size = [], 0


def rows_of(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """doc_id, text, the row's two keys, and the ``carry`` columns as one struct."""
    t = text_or_empty("text")
    d = F.col("doc_id").cast("long")
    more = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carry")] if carry else []
    return docs.select(d.alias("doc_id"), t.alias("text"), F.coalesce(d, F.lit(0)).alias("did"), F.xxhash64(d, t).alias("rk"), *more)


def _cut_rows(rows: DataFrame, units: Units) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            did, rk = b.column(0).to_numpy(), b.column(1).to_numpy()
            for own, mh, at, n in cut([t.encode() for t in b.column(2).to_pylist()], units):
                yield pa.RecordBatch.from_arrays([pa.array(mh.view(np.int64)), pa.array(did[own]), pa.array(rk[own]), pa.array(at), pa.array(n.astype(np.int32))], ["mh", "did", "rk", "start", "n"])

    return rows.select("did", "rk", "text").mapInArrow(run, "mh long, did long, rk long, start long, n int")


def _pack_rows(cand: DataFrame, units: Units) -> DataFrame:
    """One row per super-k-mer of the candidates: its minimiser, digest and packed string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for did, rk, text, spans in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                starts, counts = [s["start"] for s in spans], [s["n"] for s in spans]
                for s, p in zip(spans, units.pack(text.encode(), starts, counts), strict=True):
                    for col, v in zip(out, (s["mh"], s["hot"], xxhash.xxh3_128_digest(p), p, did, rk, s["start"]), strict=True):
                        col.append(v)
            kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["mh", "hot", "sig", "packed", "did", "rk", "start"])

    return cand.select("did", "rk", "text", "spans").mapInArrow(run, "mh long, hot boolean, sig binary, packed binary, did long, rk long, start long")


def runs_of(flags: list[int]) -> list[tuple[int, int]]:
    """Sorted offsets as (offset, length) runs."""
    out: list[list[int]] = []
    for f in flags:
        if out and f == out[-1][0] + out[-1][1]:
            out[-1][1] += 1
        else:
            out.append([f, 1])
    return [tuple(x) for x in out]


#: A bucket's strings, earliest holder first, with their counts -> for each string the offsets of its
#: repeated windows, and of those that no earlier holder has.
Bucket = Callable[[list[bytes], list[int]], list[tuple[list[int], list[int]]]]

_RUNS = "array<struct<o:int,n:int>>"
_FOUND = f"sig binary, did1 long, rk1 long, start1 long, every {_RUNS}, lead {_RUNS}"


def _cold(strings: DataFrame, bucket: Bucket, units: Units) -> DataFrame:
    """Windows of each bucket compared inside one task; a bucket has at most HOT strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        waiting: list[tuple] = []
        size = 0

        def judge(rows: list[tuple]) -> Iterator[tuple]:
            nonlocal size
            if len(rows) == 1:  # one string, so at least two occurrences of it
                n = len(units.windows(rows[0][2])) if units.name == "words" else len(rows[0][2]) - units.k + 1
                yield rows[0], [(0, n)], [(0, n)]
                return
            waiting.extend(rows)
            size += sum(len(r[2]) for r in rows)
            if size >= units.together:
                yield from settle()

        def settle() -> Iterator[tuple]:
            nonlocal size
            rows = sorted(waiting, key=lambda r: r[4:7])
            waiting.clear()
            size = 0
            if not rows:
                return
            for r, (every, lead) in zip(rows, bucket([r[2] for r in rows], [r[3] for r in rows]), strict=True):
                if every:
                    yield r, runs_of(every), runs_of(lead)

        def out(found: list[tuple]) -> pa.RecordBatch:
            kind = pa.list_(pa.struct([("o", pa.int32()), ("n", pa.int32())]))
            cols = [pa.array([r[0][1] for r in found], pa.binary()), *(pa.array([r[0][k] for r in found], pa.int64()) for k in (4, 5, 6))]
            cols += [pa.array([[{"o": o, "n": n} for o, n in r[k]] for r in found], kind) for k in (1, 2)]
            return pa.RecordBatch.from_arrays(cols, ["sig", "did1", "rk1", "start1", "every", "lead"])

        for b in batches:
            found: list[tuple] = []
            for row in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                if held and held[0][0] != row[0]:
                    found += judge(held)
                    held = []
                held.append(row)
            if found:
                yield out(found)
        found = [*(judge(held) if held else ()), *settle()]
        if found:
            yield out(found)

    sorted_rows = strings.where("NOT hot").select("mh", "sig", "packed", "c", "did1", "rk1", "start1").repartition("mh").sortWithinPartitions("mh")
    return sorted_rows.mapInArrow(run, _FOUND)


def _hot(strings: DataFrame, units: Units) -> DataFrame:
    """Windows of the hot buckets counted one by one under a 128-bit digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                w = units.windows(row[1])
                d = [xxhash.xxh3_128_digest(x) for x in w]
                n = len(w)
                fixed = [pa.array([row[k]] * n, pa.int64()) for k in (2, 3, 4, 5)]
                yield pa.RecordBatch.from_arrays([pa.array([row[0]] * n, pa.binary()), pa.array(range(n), pa.int32()), pa.array(d, pa.binary()), *fixed], ["sig", "j", "digest", "c", "did1", "rk1", "start1"])

    rows = strings.where("hot").select("sig", "packed", "c", "did1", "rk1", "start1")
    each = rows.mapInArrow(run, "sig binary, j int, digest binary, c long, did1 long, rk1 long, start1 long")
    place = F.struct("did1", "rk1", (F.col("start1") + F.col("j")).alias("p"))
    counted = each.groupBy("digest").agg(F.sum("c").alias("total"), F.min(place).alias("firstp")).where("total > 1")
    hits = each.join(counted, "digest").withColumn("isfirst", place == F.col("firstp"))
    runs = lambda c: F.transform(F.sort_array(c), lambda j: F.struct(j.alias("o"), F.lit(1).alias("n")))
    return hits.groupBy("sig", "did1", "rk1", "start1").agg(
        runs(F.collect_list("j")).alias("every"), runs(F.collect_list(F.when(F.col("isfirst"), F.col("j")))).alias("lead")
    ).select(*[x.split()[0] for x in ("sig", "did1", "rk1", "start1", "every", "lead")])


def repeated_spans(docs: DataFrame, units: Units, bucket: Bucket, keep_first: bool = False, carry: list[str] | None = None) -> DataFrame:
    """doc_id, text, spans of every row: spans (start unit, windows) of windows that occur again anywhere.

    With ``keep_first`` the first occurrence of each window, in the order of (doc_id, place), is left out;
    identical rows are one place then.
    """
    tune(docs.sparkSession)
    rows = rows_of(docs, carry)
    skm = materialize(_cut_rows(rows, units), f"superkmers-{units.name}")
    # Written, so that the join below reads two plain exchanges, of which AQE can split a hot minimiser's.
    counts = materialize(skm.groupBy("mh").agg(F.count("*").alias("c")).where("c > 1"), f"minimisers-{units.name}")
    spans = skm.join(counts, "mh").groupBy("did", "rk").agg(F.collect_set(F.struct("start", "n", "mh", (F.col("c") > HOT).alias("hot"))).alias("spans"))
    cand = materialize(rows.join(spans, ["did", "rk"], "left"), f"candidates-{units.name}")
    discard(skm, counts)
    packed = materialize(_pack_rows(cand.where("spans IS NOT NULL"), units), f"packed-{units.name}")
    strings = packed.groupBy("mh", "hot", "sig", "packed").agg(F.count("*").alias("c"), F.min("did").alias("did1"), F.min(F.struct("did", "rk", "start")).alias("firstp"))
    strings = strings.select("mh", "hot", "sig", "packed", "c", F.col("firstp.did").alias("did1"), F.col("firstp.rk").alias("rk1"), F.col("firstp.start").alias("start1"))
    found = materialize(_cold(strings, bucket, units).unionByName(_hot(strings, units)), f"repeated-{units.name}")
    release(docs.sparkSession)
    at = packed.select("sig", "did", "rk", "start").join(found, "sig")
    own = F.transform(F.col("every"), lambda r: F.struct((F.col("start") + r["o"]).alias("s"), r["n"].alias("n")))
    lead = F.when((F.col("did") == F.col("did1")) & (F.col("rk") == F.col("rk1")) & (F.col("start") == F.col("start1")), F.transform(F.col("lead"), lambda r: F.struct((F.col("start") + r["o"]).alias("s"), r["n"].alias("n"))))
    # As sets, merged before the shuffle: repeated rows share (did, rk) and have equal spans.
    hits = at.groupBy("did", "rk").agg(F.flatten(F.collect_set(own)).alias("hits"), F.flatten(F.collect_set(lead)).alias("firsts"))
    hits = hits.withColumn("firsts", F.col("firsts") if keep_first else F.lit(None).cast("array<struct<s:bigint,n:int>>"))
    return cand.drop("spans").join(hits, ["did", "rk"], "left").select("doc_id", "text", "hits", "firsts", *(["carry"] if carry else []))


def covered(n_units: int, k: int, hits: list[dict] | None, firsts: list[dict] | None) -> np.ndarray:
    """Which of a text's units lie in a window to remove."""
    out = np.zeros(n_units, bool)
    if not hits:
        return out
    start = np.zeros(n_units, bool)
    for h in hits:
        start[h["s"] : h["s"] + h["n"]] = True
    for h in firsts or ():
        start[h["s"] : h["s"] + h["n"]] = False
    at = np.flatnonzero(start)
    edge = np.zeros(n_units + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return np.cumsum(edge[:-1]) > 0
