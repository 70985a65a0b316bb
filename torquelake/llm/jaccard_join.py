"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct 5-word shingles (as 64-bit hashes); documents with equal sets are
one node, named by 64 bits of the set's 128-bit digest (names that two digests share are given anew).
Two nodes link when 100 * intersection >= 75 * union.

1. One pass gives each document's node and set size, and counts all shingles of the corpus in a table
   of hashed counters, whose size follows the corpus. A counter bounds its shingles' frequencies from
   above; its excess over the usual count estimates the holders of a frequent shingle.
2. Shingles are ordered by that estimate. If two sets of sizes a, b link, their first
   a - ceil(.75 a) + l and b - ceil(.75 b) + l shingles in that order share l shingles or more. Every
   document chooses its own l by its size and the estimated candidates of its prefix (the mean excess
   of its shingles): the more there are, the longer the prefix becomes, and the more shared prefix
   shingles a candidate needs.
3. Prefix shingles of two nodes or more are kept; frequent ones are salted for this. First each node is
   verified against its shingles' most central node only (pairs in proportion to rows, however large
   a group of near copies), which gives components. The most central node that a node is near to
   becomes its centre.
4. What still shares shingles across components is joined anew around those central nodes: with a
   centre c, the differences x ^ c and y ^ c have |x ^ y| = |x ^ c| + |y ^ c| - 2 * common, so two nodes
   that link, one of which does not link with c, have most of their differences in common. What a group
   has in common is in no difference, and the same multi-match prefixes over differences, rarest first,
   leave few pairs. Nodes of different centres give pairs by their shared prefix shingles.
5. Those pairs are verified and components closed again. A pair inside a component is not verified: it
   cannot change the components.

Verification sends a set once for each pair it follows in, and a leader's once for each ``PART`` of its
followers; one leader's set is in memory at a time.

Defined results: a null, empty or blank text has an empty set and is its own component; fewer than
five words are one shingle; repeated rows and equal texts are one node; a null doc_id never names a
component unless its node has no other; an empty table gives an empty result; a text's length has no
limit but that its words and their hashes fit a worker's memory; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from torquelake.llm.common import discard, materialize, release, tune
from torquelake.llm.repeats import mix, rows_of, word_hashes

SHINGLE, PERCENT = 5, 75
#: Hashed counters (powers of two) and input bytes for each; counters in one row of a survey.
MIN_BITS, MAX_BITS, BYTES_PER_COUNTER, CHUNK_BITS = 20, 24, 256, 12
SALTS = 64
#: A prefix is lengthened by at least one shingle in SHARE of the set, and for each doubling of its mean estimated candidates by one in COST_SHARE.
SHARE, COST_SHARE = 16, 64
#: Followers of one leader that are verified together; differences for each further match in step 4.
PART, DIFFERENCES_PER_MATCH = 512, 16
#: Holders of a difference that are compared with its other holders before all pairs of what is still apart.
LEADERS = 4
#: Nodes whose numbers are broadcast at most (some 40 bytes each); beyond, tables of nodes are shuffled.
MAX_BROADCAST_NODES = 1_000_000
#: A node has a centre if their difference is at most so many times that of two sets that link.
CENTRE_REACH = 4


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, with A-Z lower-cased."""
    h, counts = word_hashes([t.encode().lower() for t in texts])
    end = np.cumsum(counts)
    g = h[: max(0, len(h) - SHINGLE + 1)]
    for i in range(1, SHINGLE):
        g = mix(g * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(g)])
    out = []
    for e, n in zip(end.tolist(), counts.tolist(), strict=True):
        if n >= SHINGLE:
            s = np.sort(g[e - n : e - SHINGLE + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            continue
        one = np.array([n], np.uint64)
        for x in h[e - n : e]:
            one = mix(one * np.uint64(0x9E3779B97F4A7C15) + x)
        out.append(one if n else h[:0])
    return out


def name_of(s: np.ndarray, renamed: dict[tuple[int, int], int] | None = None) -> tuple[int, int]:
    """A set's node and the other half of its digest."""
    d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
    node, check = int(d[0]), int(d[1])
    return (renamed or {}).get((node, check), node), check


def least_matches(n):
    """Shared prefix shingles that any candidate of a set of ``n`` needs at least (its partner may be smaller by a quarter)."""
    return 1 + F.floor(F.floor(n * PERCENT / 100) / SHARE)


def overlap(a, b):
    """Intersection that two sets of sizes ``a`` and ``b`` need to link."""
    return F.ceil((a + b) * PERCENT / (100 + PERCENT))


def overlap_needed(n: int) -> int:
    return -(-PERCENT * n // 100)


def excess_table(counts: np.ndarray) -> np.ndarray:
    """For each counter 0 if usual, else the class (log2) of its excess over the usual count."""
    usual = np.median(counts)
    spread = max(1.0, np.median(np.abs(counts - usual)) * 1.4826)
    limit = usual + 8 * spread + 8
    over = np.maximum(counts - limit, 0)
    return np.where(over > 0, 1 + np.floor(np.log2(over + 1)), 0).astype(np.int8)


def prefix(s: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(prefix shingles, their classes, matches needed) of a set: rare first, lengthened by the estimated candidates in it."""
    c = classes[_bucket(s, len(classes))]
    order = np.lexsort((mix(s), c))
    s, c = s[order], c[order]
    need = overlap_needed(len(s))
    short = len(s) - need + 1
    candidates = float(np.ldexp(1.0, c[:short].astype(int))[c[:short] > 0].sum()) / short
    matches = int(min(need, 1 + len(s) // SHARE + min(len(s) // SHARE, int(len(s) / COST_SHARE * np.log2(1 + candidates)))))
    return s[: short + matches - 1], c[: short + matches - 1], matches


def _bucket(s: np.ndarray, size: int) -> np.ndarray:
    return (s >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _survey(rows: DataFrame, size: int) -> DataFrame:
    """Rows (doc_id, did, rk, n, node, other) of all documents, and rows (chunk, counts) of each task's shingle counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int32)
        names = ["doc_id", "did", "rk", "n", "node", "other", "chunk", "counts"]
        for b in batches:
            sets = shingle_sets(b.column(3).to_pylist())
            if not sets:
                continue
            at = _bucket(np.concatenate(sets), size)
            if len(at) * 8 > size:
                total += np.bincount(at, minlength=size).astype(np.int32)
            else:
                np.add.at(total, at, 1)
            named = [name_of(s) for s in sets]
            own = [pa.array([len(s) for s in sets], pa.int64()), *(pa.array([x[k] for x in named], pa.int64()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *own, pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], names)
        if total.any():
            chunks = _chunks(total)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(chunks[0]), pa.int64())] * 6 + chunks, names)

    return rows.select("doc_id", "did", "rk", "text").mapInArrow(run, "doc_id long, did long, rk long, n long, node long, other long, chunk int, counts binary")


def _chunks(counts: np.ndarray) -> list[pa.Array]:
    parts = [p.tobytes() for p in np.split(counts, max(1, len(counts) >> CHUNK_BITS))]
    return [pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())]


def _counts(chunks: DataFrame, size: int) -> np.ndarray:
    """The sums of all tasks' counters: added up chunk by chunk in tasks, then one row for each chunk to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = np.frombuffer(raw, np.int32)
                sums[k] = sums[k] + v if k in sums else v.astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in sums.values()], pa.binary())], ["chunk", "counts"])

    out = np.zeros(size, np.float32)
    width = size // max(1, size >> CHUNK_BITS)
    for r in chunks.select("chunk", "counts").repartition("chunk").mapInArrow(run, "chunk int, counts binary").toLocalIterator():
        out[r.chunk * width : (r.chunk + 1) * width] = np.frombuffer(r.counts, np.float32)
    return out


def _renamed(members: DataFrame) -> dict[tuple[int, int], int]:
    """New names for nodes that share theirs with another digest: about documents^2 / 2^65 of them, so none or a few in any corpus."""
    clash = members.where("n > 0").groupBy("node").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo < hi")
    found = members.join(clash, "node").where("other > lo").select("node", "other").distinct().collect()
    return {(r.node, r.other): int(np.uint64(xxhash.xxh3_64_intdigest(np.array([r.node, r.other]).tobytes())).view(np.int64)) for r in found}


def _prefixes(rows: DataFrame, classes: np.ndarray, renamed: dict) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(classes)  # one byte a counter, 16 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal sets give their prefix once in a task
        for b in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            for s in shingle_sets(b.column(0).to_pylist()):
                if not len(s) or (node := name_of(s, renamed)[0]) in seen:
                    continue
                seen.add(node)
                p, c, matches = prefix(s, shared.value)
                k = len(p)
                for col, v in zip(cols, (p.view(np.int64), np.full(k, node), np.full(k, len(s)), np.full(k, matches, np.int32), c > 0, np.arange(k, dtype=np.int32)), strict=True):
                    col.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["token", "node", "n", "matches", "heavy", "pos"])

    return rows.select("text").mapInArrow(run, "token long, node long, n long, matches int, heavy boolean, pos int")


def _sets(rows: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """node, shingles of each row of ``reps`` (node, did, rk). A table of hashed row keys keeps most other rows from being cut again or moved."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int32)
        for b in batches:
            np.add.at(total, _bucket(mix(b.column(0).to_numpy().view(np.uint64)), size), 1)
        if total.any():
            yield pa.RecordBatch.from_arrays(_chunks(total), ["chunk", "counts"])

    keys = _counts(reps.select("rk").mapInArrow(tally, "chunk int, counts binary"), size) > 0
    shared = rows.sparkSession.sparkContext.broadcast(keys)  # one byte a counter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(shared.value[_bucket(mix(b.column(1).to_numpy().view(np.uint64)), size)]))
            sets = shingle_sets(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s.tobytes() for s in sets], pa.binary())], ["did", "rk", "shingles"])

    own = rows.select("did", "rk", "text").mapInArrow(run, "did long, rk long, shingles binary")
    return own.join(_small(reps), ["did", "rk"]).select("node", "shingles").dropDuplicates(["node"])


def _followers(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Each leader a's set, then its followers' b, in parts of about PART followers: a, part, node (null for the leader), shingles."""
    pairs = materialize(pairs, "pairs")
    few = pairs.count() <= MAX_BROADCAST_NODES  # neither table below has more rows
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    of_b = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("node"))
    of_b = sets.join(F.broadcast(of_b) if few else of_b, "node").select("a", "part", "node", "shingles")
    of_a = sets.join(F.broadcast(parts) if few else parts, F.col("a") == F.col("node")).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("node"), "shingles")
    return of_a.unionByName(of_b).repartition("a", "part").sortWithinPartitions("a", "part", F.col("node").asc_nulls_first())


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]]:
    """(leader, follower, their sets, which of the follower's shingles the leader has) of each batch of ``_followers``."""
    leader = np.zeros(0, np.uint64)
    for b in batches:
        out = []
        for a, node, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            s = np.frombuffer(raw.as_buffer(), np.uint64)
            if node is None:
                leader = np.array(s)
            else:
                out.append((a, node, leader, s, leader[np.minimum(np.searchsorted(leader, s), len(leader) - 1)] == s))
        yield out


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with the sizes na, nb of their sets and of the intersection, ``both``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _compared(batches):
            rows = [(a, b, len(x), len(y), int(both.sum())) for a, b, x, y, both in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], ["a", "b", "na", "nb", "both"])

    return _followers(pairs.select("a", "b"), sets).mapInArrow(run, "a long, b long, na long, nb long, both long")


def links(compared: DataFrame) -> DataFrame:
    return compared.where(100 * F.col("both") >= PERCENT * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _differences(anchored: DataFrame, sets: DataFrame) -> DataFrame:
    """centre, token, node, n, d, links of every shingle that just one of a node and its centre has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _compared(batches):
            cols: list[list[np.ndarray]] = [[] for _ in range(7)]
            for a, b, x, y, both in found:
                missing = np.ones(len(x), bool)
                missing[np.searchsorted(x, y[both])] = False
                t = np.concatenate([y[~both], x[missing]]).view(np.int64)
                k = len(t)
                for col, v in zip(cols, (np.full(k, a), t, np.full(k, b), np.full(k, len(y)), np.full(k, len(x)), np.full(k, k), np.full(k, 7 * k <= len(x) + len(y))), strict=True):
                    col.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["centre", "token", "node", "n", "nc", "d", "links"])

    pairs = anchored.select(F.col("centre").alias("a"), F.col("node").alias("b"))
    return _followers(pairs, sets).mapInArrow(run, "centre long, token long, node long, n long, nc long, d long, links boolean")


def centred_prefixes(anchored: DataFrame, sets: DataFrame) -> DataFrame:
    """Prefixes of the nodes' differences to their centres: centre, token, node and the numbers that ``_centred`` compares.

    |a ^ b| <= (|a| + |b|) / 7 is what linking means. With d the difference to the centre c, and 7 d > n + nc
    for one of the two, the other has at least (7 d + nc - n) / 14 of its differences in common with it; a
    node that does not link has (7 d - n - nc) / 14 at least in common with any. Differences that no other
    node of the centre has count as seen, and come first.
    """
    every = materialize(_differences(anchored, sets), "differences")
    shared = every.groupBy("centre", "token").agg(F.count("*").alias("df")).where("df > 1")
    every = every.join(shared, ["centre", "token"])
    node = Window.partitionBy("centre", "node")
    every = every.withColumn("alone", F.col("d") - F.count("*").over(node)).withColumn("pos", F.col("alone") + F.row_number().over(node.orderBy("df", "token")) - 1)
    with_open = F.floor((7 * F.col("d") + F.col("nc") - F.col("n")) / 14) + 1
    with_any = F.greatest(F.lit(1), F.ceil((7 * F.col("d") - F.col("n") - F.col("nc")) / 14))
    every = every.withColumns({"least": with_open.cast("long"), "any": with_any.cast("long")})
    # A prefix leaves out its last "spare" differences; of c that two have in common it holds c - spare at least.
    spare = lambda need: F.greatest(F.lit(0), need - 1 - F.floor(F.col("d") / DIFFERENCES_PER_MATCH)).cast("long")
    every = every.withColumns({"spare": spare(F.col("least")), "spare_any": spare(F.col("any"))})
    every = every.where(F.col("d") - F.col("alone") >= F.when(F.col("links"), F.col("least")).otherwise(F.col("any")))
    every = every.where(F.col("pos") < F.col("d") - F.when(F.col("links"), F.col("spare")).otherwise(F.col("spare_any")))
    return materialize(every.select("centre", "token", "node", "n", "d", "alone", "pos", "links", "spare", "spare_any"), "difference-prefixes")


def _centred(pairs: DataFrame) -> tuple:
    """For rows of two nodes of one centre that share a difference (columns with _a and _b): whether they may link, and the shared ones they need."""
    open_a, open_b = ~F.col("links_a"), ~F.col("links_b")
    common = F.ceil((7 * (F.col("d_a") + F.col("d_b")) - F.col("n_a") - F.col("n_b")) / 14)
    possible = (F.col("comp_a") != F.col("comp_b")) & (open_a | open_b) & _similar_sizes("n_a", "n_b") & (common <= F.least(F.col("d_a") - F.col("alone_a"), F.col("d_b") - F.col("alone_b")))
    # With one that links with the centre, the other's longer prefix counts.
    spare = {x: F.when(~F.col(f"links_{x}") & F.col(f"links_{y}"), F.col(f"spare_any_{x}")).otherwise(F.col(f"spare_{x}")) for x, y in ("ab", "ba")}
    possible = possible & (F.col("pos_a") < F.col("d_a") - spare["a"]) & (F.col("pos_b") < F.col("d_b") - spare["b"])
    return possible, common - F.greatest(spare["a"], spare["b"])


def _side(rows: DataFrame, x: str, keys: list[str]) -> DataFrame:
    return rows.select(*keys, *[F.col(c).alias(f"{c}_{x}") for c in rows.columns if c not in keys])


def centred_pairs(prefixes: DataFrame, comps: DataFrame, leaders: range = range(0)) -> DataFrame:
    """Candidate pairs (a, b) by shared differences: all in different components, or those of ``leaders`` (numbers that pick them) with a difference's other holders."""
    keys = ["centre", "token"]
    rows = prefixes.join(_small(comps), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    held = rows.groupBy(*keys).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), *[F.max(F.struct(F.xxhash64("node", "token", F.lit(k)).alias("r"), *[F.col(c) for c in rows.columns if c not in keys])).alias(f"f{k}") for k in leaders]).where("lo < hi")
    if leaders:
        first = held.select(*keys, F.inline(F.array_distinct(F.array(*[F.struct(*[F.col(f"f{k}")[c].alias(c) for c in rows.columns if c not in keys]) for k in leaders]))))
        pairs = _side(first, "a", keys).join(_side(rows, "b", keys), keys)
    else:
        rows = materialize(rows.join(held.select(*keys), keys), "open-differences")
        order = (F.col("node_a") < F.col("node_b")) | F.col("links_b")  # each pair once
        pairs = _side(rows.where("NOT links"), "a", keys).join(_side(rows, "b", keys), keys).where(order)
    possible, need = _centred(pairs)
    pairs = pairs.where(possible).groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b")).agg(F.count("*").alias("k"), F.min(need).alias("need"))
    # A leader leads only some of the differences it shares, so its count says little.
    return (pairs if leaders else pairs.where("k >= need")).select("a", "b")


def connected_components(edges: DataFrame) -> DataFrame:
    """node, comp (its component's smallest node) of all nodes of ``edges`` (a, b).

    A node's label becomes the smallest of its own, its neighbours' and its label's; one aggregation a round, as the driver plans each.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
    few = labels.count() <= MAX_BROADCAST_NODES
    old = F.lit(None).cast("long").alias("old")
    while True:
        known = F.broadcast(labels) if few else labels
        near = both.join(known, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "comp", old)
        jump = labels.select(F.col("node").alias("a"), F.col("comp").alias("b")).join(known, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "comp", F.col("b").alias("old"))
        new = near.unionByName(jump).groupBy("node").agg(F.max("old").alias("old"), F.least(F.min("comp"), F.max("old")).alias("comp"))
        new = materialize(new, "labels")
        labels = new.select("node", "comp")
        if new.where("comp <> old").isEmpty():
            release(edges.sparkSession)
            return labels


def _similar_sizes(a: str, b: str):
    return (100 * F.least(a, b) >= PERCENT * F.greatest(a, b))


def _table_size(docs: DataFrame) -> int:
    """Counters for the corpus: a power of two, by the input's bytes as Spark estimates them (the least where it can't)."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = size if size < 1 << 60 else 0
    return 1 << min(MAX_BITS, max(MIN_BITS, (size // BYTES_PER_COUNTER).bit_length()))


def _small(nodes: DataFrame) -> DataFrame:
    """A stored table of a few numbers for each node, broadcast if it has at most MAX_BROADCAST_NODES rows; it is counted once."""
    if not hasattr(nodes, "n_rows"):
        nodes.n_rows = nodes.count()
    return F.broadcast(nodes) if nodes.n_rows <= MAX_BROADCAST_NODES else nodes


def _led(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of each shingle's leader, the holder with the highest rank, and its other holders, with a's rank.

    A sieve only: pairs with few shingles in common here come again later, if they still matter.
    """
    leader = F.max(F.struct("rank", "node", "n")).alias("f")
    firsts = rows.groupBy("token").agg(leader).select("token", F.col("f.node").alias("a"), F.col("f.n").alias("na"), F.col("f.rank").alias("rank"))
    found = rows.drop("rank").join(firsts, "token").where((F.col("node") != F.col("a")) & _similar_sizes("n", "na"))
    found = found.groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("k"), F.min("matches").alias("need"), F.max("rank").alias("rank"))
    return found.where("2 * k >= need").select("a", "b", "rank")


def _open(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """``rows`` of shingles that two components or more hold, with each node's component."""
    own = rows.join(_small(comps), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    several = own.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    return materialize(own.join(several, "token"), "open-rows")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, node of every row of ``docs``."""
    tune(docs.sparkSession)
    rows, size = rows_of(docs), _table_size(docs)
    survey = materialize(_survey(rows, size), "survey")
    members = survey.where("chunk IS NULL").select("doc_id", "did", "rk", "n", "node", "other")
    renamed = _renamed(members)
    if renamed:
        new = docs.sparkSession.createDataFrame([(*k, v) for k, v in renamed.items()], "node long, other long, new long")
        members = members.join(F.broadcast(new), ["node", "other"], "left").withColumn("node", F.coalesce("new", "node"))
    members = members.select("doc_id", "did", "rk", "n", "node")

    tokens = _prefixes(rows, excess_table(_counts(survey.where("chunk IS NOT NULL"), size)), renamed).withColumn("salt", F.when(F.col("heavy"), F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(F.lit(0)))
    w = Window.partitionBy("token", "salt")
    tokens = tokens.withColumns({"lo": F.min("node").over(w), "hi": F.max("node").over(w)}).where("heavy OR lo < hi")
    prefixes = materialize(tokens.select("token", "node", "n", "matches", "pos").distinct(), "shared-tokens")
    # Prefix shingles of a node that nobody shares are in no intersection: what is "lost" bounds every overlap.
    k = prefixes.groupBy("node", "n", "matches").agg(F.count("*").alias("k")).where(F.col("k") >= least_matches(F.col("n")))
    lost = (F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + F.col("matches") - F.col("k")).cast("long")
    wanted = materialize(k.select("node", lost.alias("lost")), "candidate-nodes")
    shared = materialize(prefixes.join(_small(wanted), "node"), "candidate-tokens")
    discard(prefixes)

    reps = members.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("did", "rk")).alias("r")).select("node", F.col("r.did").alias("did"), F.col("r.rk").alias("rk"))
    sets = materialize(_sets(rows, materialize(reps, "candidate-rows"), size), "sets")

    # Of the nodes with a shingle the most central leads: its prefix shingles have the most holders on average.
    holders = materialize(shared.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "holders")
    central = materialize(shared.join(holders, "token").groupBy("node").agg((F.sum("df") / (F.count("*") + F.max("lost"))).alias("rank")), "centrality")
    pairs = materialize(_led(shared.join(_small(central), "node")), "leader-pairs")
    compared = materialize(compare(pairs, sets), "compared")
    near = 7 * (F.col("na") + F.col("nb") - 2 * F.col("both")) <= CENTRE_REACH * (F.col("na") + F.col("nb"))
    centres = compared.where(near).join(pairs, ["a", "b"]).groupBy(F.col("b").alias("node")).agg(F.max(F.struct("rank", "a"))["a"].alias("centre"))
    centres = materialize(centres, "centres")
    edges = links(compared)
    comps = connected_components(edges)
    discard(holders)

    # Only shingles that join two components or more still matter. Another node leads each of them once.
    rest = _open(shared.join(_small(centres), "node", "left").withColumn("centre", F.coalesce("centre", "node")), comps)
    discard(shared)
    known = pairs.select("a", "b")
    pairs = materialize(_led(rest.withColumn("rank", F.xxhash64("node", F.lit(1)).cast("double"))), "leader-pairs")
    edges = edges.unionByName(links(materialize(compare(pairs.join(known, ["a", "b"], "left_anti"), sets), "compared")))
    known = known.unionByName(pairs.select("a", "b"))
    known = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
    comps = connected_components(edges)
    last, rest = rest, _open(rest.drop("comp"), comps)
    discard(last)

    anchored = materialize(rest.where("centre <> node").select("centre", "node", "comp").distinct(), "centred-nodes")
    mixed = materialize(rest.groupBy("token").agg(F.min("centre").alias("lo"), F.max("centre").alias("hi")).where("lo < hi").select("token"), "mixed-tokens")
    mixed = rest.join(mixed, "token")
    side = lambda x: mixed.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "matches", "comp", "pos", "lost", "centre")])
    # Of an overlap o, the first l common shingles lie among a side's first n - o + l; and o is at most n - lost.
    o = overlap(F.col("n_a"), F.col("n_b"))
    need = F.least("matches_a", "matches_b")
    possible = (F.col("node_a") < F.col("node_b")) & (F.col("comp_a") != F.col("comp_b")) & (F.col("centre_a") != F.col("centre_b")) & _similar_sizes("n_a", "n_b")
    for x in "ab":
        possible = possible & (F.col(f"pos_{x}") < F.col(f"n_{x}") - o + need) & (o <= F.col(f"n_{x}") - F.col(f"lost_{x}"))
    cross = side("a").join(side("b"), "token").where(possible).groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b")).agg(F.count("*").alias("k"), F.min(need).alias("need"))
    cross = cross.where("k >= need").select("a", "b")

    prefixes = centred_prefixes(anchored, sets)
    # A few holders of each difference with its others, again with other holders; then what is still apart.
    for leaders in (range(LEADERS), range(LEADERS, 2 * LEADERS), range(0)):
        pairs = centred_pairs(prefixes, comps, leaders)
        pairs = materialize((pairs if leaders else pairs.unionByName(cross)).join(known, ["a", "b"], "left_anti").distinct(), "open-pairs")
        if pairs.isEmpty():
            continue
        more = materialize(links(compare(pairs, sets)), "more-edges")
        known = known.unionByName(pairs)
        if not more.isEmpty():
            edges = edges.unionByName(more)
            comps = connected_components(edges)
    discard(rest, sets, prefixes)

    smallest = members.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc"))
    named = smallest.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    of_comp = named.groupBy("comp").agg(F.min("doc").alias("component_id"))
    of_node = named.join(of_comp, "comp").select("node", "component_id")
    out = members.join(of_node, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "node")
