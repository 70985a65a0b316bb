"""Stored inverted index for BM25: postings packed by document, the greatest share of each term in each block of documents, top-k that skips blocks.

A block holds up to ``2 ** BLOCK_BITS`` documents of similar length. The sum over a query's terms of weight x greatest share in the
block bounds the score of each document there, so blocks whose bound is below the k-th best score found so far are skipped.

Blocks are stored by packs of up to ``text_blocks.ROWS`` documents. A pack meets a block of queries in one task, where bounds and
scores are matrix products; rows are made only for a query's first blocks and for what may be among its best.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from torquelake.operators import blocks, text_blocks
from torquelake.operators.retrieval import rank, tokens
from torquelake.operators.text_blocks import Pair, cell, numbers, query_block, rows_of
from torquelake.session import BIG_ROWS, stored

#: Documents of a block are those of a pack with the same row number divided by 2 to this power.
BLOCK_BITS = 5
#: Rows of (query, first block) that are broadcast at most; more are joined by a shuffle on the pack.
MAX_BROADCAST_PAIRS = 50_000
#: Scores this close count as equal in ``rank``.
TIE = 1e-8

_MOST = ["terms", "m_ends", "m_cols", "most"]
_POSTED = ["ids", "ends", "cols", "share"]


def _shared(made: DataFrame, avgdl: float) -> DataFrame:
    """Packs (pack, ids, terms, ends, cols, share, m_ends, m_cols, most): shares of the postings, and for each block its terms and their greatest share."""
    out = ["pack", "ids", "terms", "ends", "cols", "share", "m_ends", "m_cols", "most"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                dl, ends, cols = cell(b, i, "dl").values.to_numpy(), numbers(b, i, "ends"), numbers(b, i, "cols")
                row, n = rows_of(ends), max(len(cell(b, i, "terms").values), 1)
                share = text_blocks.shares(numbers(b, i, "tf"), dl[row], avgdl)
                key = (row >> BLOCK_BITS) * n + cols
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.diff(key[order], prepend=-1))
                most = np.maximum.reduceat(share[order], first) if len(first) else share
                block, m_cols = np.divmod(key[order][first], n)
                m_ends = np.searchsorted(block, np.arange(-(-len(dl) >> BLOCK_BITS)), "right")
                ints = [pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (ends, cols, m_ends, m_cols)]
                raw = [pa.array([x.tobytes()], pa.binary()) for x in (share, most)]
                same = [b.column(b.schema.get_field_index(c)).slice(i, 1) for c in ("pack", "ids", "terms")]
                yield pa.RecordBatch.from_arrays([*same, ints[0], ints[1], raw[0], ints[2], ints[3], raw[1]], out)

    kinds = [T.LongType(), made.schema["ids"].dataType, made.schema["terms"].dataType, *[T.BinaryType()] * 6]
    rows = made.select(F.monotonically_increasing_id().alias("pack"), "ids", "dl", "terms", "ends", "cols", "tf")
    return rows.mapInArrow(run, T.StructType([T.StructField(a, k) for a, k in zip(out, kinds, strict=True)]))


def _bounds(b: pa.RecordBatch, i: int, q: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(bounds of the blocks of a pack for each query of a block, which of them hold a term of the query)."""
    ends = numbers(b, i, "m_ends")
    pair = Pair(q, (len(ends), cell(b, i, "terms").values, ends, numbers(b, i, "m_cols"), numbers(b, i, "most", np.float64)))
    bound = pair.product(np.maximum(pair.weight, 0.0), pair.part)
    if len(pair.weight) and pair.weight.min() <= 0:
        return bound, pair.product(np.ones(len(pair.weight)), np.ones(len(pair.part))) > 0.5
    return bound, bound > 0


def _scored(b: pa.RecordBatch, i: int, q: tuple, held: np.ndarray) -> tuple[np.ndarray, pa.Array, Pair]:
    """(block, id of each document of the chosen blocks of a pack, their pair with the queries)."""
    ends, ids = numbers(b, i, "ends"), cell(b, i, "ids").values
    block, size = np.arange(len(ends)) >> BLOCK_BITS, np.diff(ends, prepend=0)
    docs = np.flatnonzero(held[block])
    entry = text_blocks._spans(ends[docs] - size[docs], size[docs])
    d = (len(docs), cell(b, i, "terms").values, np.cumsum(size[docs]), numbers(b, i, "cols")[entry], numbers(b, i, "share", np.float64)[entry])
    return block[docs], ids.take(pa.array(docs)), Pair(q, d)


def _still(b: pa.RecordBatch, i: int, q: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which blocks of a pack may hold a hit of each query, which hold a term of it, the least score of a hit)."""
    least, found = np.full(q[0], -np.inf), cell(b, i, "least").values
    if found is not None and len(found):
        least[found.field("row").to_numpy()] = found.field("least").to_numpy()
    bound, hit = _bounds(b, i, q)
    return hit & (bound >= (least - TIE)[:, None]), hit, least


def _each(pairs: DataFrame, columns: list[str], schema: str | T.StructType, step: Callable[[pa.RecordBatch, int, pa.Array, tuple], list | None]) -> DataFrame:
    """The columns that ``step`` makes of each pair of a pack and a block of queries."""
    blocks.small_batches(pairs.sparkSession)
    names = [f.name for f in schema.fields] if isinstance(schema, T.StructType) else [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                made = step(b, i, *query_block(b, i))
                if made is not None:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in made], names)

    asked = [c for c in pairs.columns if c in ("block", "least") or c.startswith("q_")]
    return pairs.select(*columns, *asked).mapInArrow(run, schema)


class InvertedIndex:
    """In ``folder``: ``packs`` (pack, documents, postings with shares, greatest shares by block), ``terms`` (term, df, idf)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.packs, self.terms = (spark.read.parquet(f"{self.folder}/{t}") for t in ("packs", "terms"))

    @classmethod
    def build(cls, docs: DataFrame, folder: str, doc: str = "doc_id", text: str = "text") -> InvertedIndex:
        """Index all documents (``doc`` is a key); texts are tokenised once. Null texts count as documents without a term.

        Rows are dealt in ranges of (hash of the text, id) and sorted by text length, hash and id there, so that equal
        texts meet in a block and long texts are spread over all tasks. Packs are dealt out evenly, whatever their terms. Negative idf is floored at a share of the mean idf, as in ``retrieval.bm25_index``.
        """
        spark, folder = docs.sparkSession, folder.rstrip("/")
        size = F.coalesce(F.length(text), F.lit(0))
        rows = docs.select(F.col(doc).alias("id"), F.col(text).alias("text"), size.alias("size"), F.xxhash64(text).alias("hash"))
        rows = rows.repartitionByRange(2 * spark.sparkContext.defaultParallelism, "hash", "id").sortWithinPartitions("size", "hash", "id")
        made = stored(text_blocks.packed(rows.select("id", tokens(F.col("text")).alias("w")), text_blocks.ROWS), "text-blocks", **BIG_ROWS)
        n, avgdl = text_blocks.corpus(made)
        text_blocks.term_weights(made, n).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{folder}/terms")
        _shared(blocks.spread(made), avgdl).write.options(**BIG_ROWS).parquet(f"{folder}/packs")
        return cls(spark, folder)

    def _asked(self, queries: DataFrame, query: str, text: str) -> DataFrame:
        """Blocks of queries with the idf of their terms; rows with one id are one query."""
        one = stored(queries.select(F.col(query).alias("id"), tokens(F.col(text)).alias("w")).groupBy("id").agg(F.flatten(F.collect_list("w")).alias("w")), "queries")
        return text_blocks.weighed(text_blocks.packed(one.repartition(max(1, math.ceil(one.count() / blocks.QUERIES))), blocks.QUERIES), self.terms.select("term", "idf"))

    def _plan(self, queries: DataFrame, top_k: int, query: str, text: str) -> tuple[DataFrame, DataFrame]:
        """(blocks of queries with the least score of a hit, the first blocks of each query)."""
        if top_k < 1:
            raise ValueError("top_k must be at least 1")
        asked = self._asked(queries, query, text)
        # Twice the blocks that top_k documents fill: a better k-th score for few postings more.
        seeds = 2 * math.ceil(top_k / (1 << BLOCK_BITS))

        def lead(b: pa.RecordBatch, i: int, ids: pa.Array, q: tuple) -> list:
            bound, hit = _bounds(b, i, q)
            row, at = blocks.may_lead(np.where(hit, bound, blocks.OUT), seeds) if bound.size else (np.zeros(0, int),) * 2
            keep = blocks.first_of_equal(row, bound[row, at], at, seeds)
            row, at = row[keep], at[keep]
            return [np.full(len(row), cell(b, i, "block").as_py()), row, np.full(len(row), cell(b, i, "pack").as_py()), at, bound[row, at]]

        found = _each(self.packs.crossJoin(text_blocks.small(asked)), ["pack", *_MOST], "block long, row long, pack long, at long, bound double", lead)
        by_query = Window.partitionBy("block", "row")
        first = by_query.orderBy(F.desc("bound"), "pack", "at")
        head = stored(found.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= seeds).drop("_n"), "first-blocks")

        def score(b: pa.RecordBatch, i: int, ids: pa.Array, q: tuple) -> list:
            wanted = np.zeros((q[0], len(numbers(b, i, "ends")) + (1 << BLOCK_BITS) - 1 >> BLOCK_BITS), bool)
            chosen = cell(b, i, "wanted").values
            wanted[chosen.field("row").to_numpy(), chosen.field("at").to_numpy()] = True
            block, _, pair = _scored(b, i, q, wanted.any(0))
            s, hit = pair.scores()
            row, at = np.nonzero(hit & wanted[:, block])
            return [np.full(len(row), cell(b, i, "block").as_py()), row, s[row, at]]

        wanted = head.groupBy("block", "pack").agg(F.collect_list(F.struct("row", "at")).alias("wanted"))
        wanted = F.broadcast(wanted) if head.count() <= MAX_BROADCAST_PAIRS else wanted
        pairs = self.packs.join(wanted, "pack").join(text_blocks.small(asked), "block")
        scores = _each(pairs, ["wanted", "terms", *_POSTED], "block long, row long, score double", score)
        last = scores.withColumn("_n", F.row_number().over(by_query.orderBy(F.desc("score")))).where(F.col("_n") == top_k)
        least = last.groupBy("block").agg(F.collect_list(F.struct("row", F.col("score").alias("least"))).alias("least"))
        return stored(asked.join(least, "block", "left"), "asked-blocks"), head

    def search(self, queries: DataFrame, top_k: int = 5, query: str = "query_id", text: str = "text") -> DataFrame:
        """query, doc, score, rank: the ``top_k`` documents that hold a query term, as ``retrieval.rank`` orders them."""
        asked, _ = self._plan(queries, top_k, query, text)

        def best(b: pa.RecordBatch, i: int, ids: pa.Array, q: tuple) -> list | None:
            may, _, least = _still(b, i, q)
            if not may.any():
                return None
            block, docs, pair = _scored(b, i, q, may.any(0))
            s, hit = pair.scores()
            s = np.where(hit & may[:, block] & (s >= (least - TIE)[:, None]), s, blocks.OUT)
            row, col = blocks.may_lead(s, top_k)
            score = pair.exact(row, col)
            keep = blocks.first_of_equal(row, score, blocks.places_of(docs)[col], top_k)
            return [ids.take(pa.array(row[keep])), docs.take(pa.array(col[keep])), score[keep]]

        kinds = {"query": asked.schema["q_ids"].dataType.elementType, "doc": self.packs.schema["ids"].dataType.elementType, "score": T.DoubleType()}
        schema = T.StructType([T.StructField(a, k) for a, k in kinds.items()])
        return rank(_each(self.packs.crossJoin(text_blocks.small(asked)), [*_MOST, *_POSTED], schema, best), top_k=top_k)

    def work(self, queries: DataFrame, top_k: int = 5, query: str = "query_id", text: str = "text") -> DataFrame:
        """query, blocks read, of_blocks that hold a term of the query: what a search costs."""
        asked, head = self._plan(queries, top_k, query, text)

        def count(b: pa.RecordBatch, i: int, ids: pa.Array, q: tuple) -> list:
            may, hit, _ = _still(b, i, q)
            has = np.flatnonzero(hit.any(1))
            return [ids.take(pa.array(has)), may[has].sum(1), hit[has].sum(1)]

        schema = T.StructType([T.StructField("query", asked.schema["q_ids"].dataType.elementType), T.StructField("blocks", T.LongType()), T.StructField("of_blocks", T.LongType())])
        held = _each(self.packs.crossJoin(text_blocks.small(asked)), _MOST, schema, count)
        # First blocks that the k-th score rules out afterwards were read too.
        ids = asked.select("block", F.posexplode("q_ids").alias("row", "query"))
        least = asked.select("block", F.inline("least"))
        late = head.join(least, ["block", "row"]).where(F.col("bound") < F.col("least") - TIE).join(ids, ["block", "row"])
        both = held.unionByName(late.select("query", F.lit(1).cast("long").alias("blocks"), F.lit(0).cast("long").alias("of_blocks")))
        return both.groupBy("query").agg(F.sum("blocks").alias("blocks"), F.sum("of_blocks").alias("of_blocks"))
