"""Dense top-k block by block: packed queries meet packed rows, and only what may be among the best comes out.

A block is one row of Spark: its vectors as bytes, their ids and payload as an array. Each block of queries meets each block of
rows (or those of its cell) in one task, which holds one pair of blocks at a time. A matrix product finds the rows that may be among the best; their cosines are
then summed in the order of ``retrieval.cosine``, so equal vectors have equal scores wherever they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from torquelake.session import stored

#: Queries and rows of a block at most.
QUERIES, ROWS = 512, 8192
#: Scores this close count as equal until they are rounded (``retrieval.rank`` rounds at 9 places).
TIE = 2e-9
#: Query blocks are broadcast up to this size; more meet the rows in a plain cross join.
MAX_BROADCAST_BYTES = 64 << 20
#: Stand for no score (null, sorted last) and for a pair that was left out.
NULL, OUT = -1e300, -np.inf


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few blocks, so that a worker's memory does not follow the number of rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def spread(df: DataFrame) -> DataFrame:
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def packed(df: DataFrame, rows: Column, vector: str, limit: int, cell: str | None = None, distance: str | None = None) -> DataFrame:
    """Blocks (_cell, dim, rows, m, d) of at most ``limit`` rows of one cell and one number of dimensions.

    Vectors that are null, empty or hold a null have ``dim`` 0 and no score with anything.
    """
    small_batches(df.sparkSession)
    slim = df.select(rows.alias("rows"), F.col(vector).alias("v"), (F.col(cell) if cell else F.lit(0)).cast("int").alias("_cell"), (F.col(distance) if distance else F.lit(0.0)).alias("d"))
    kind = kind_of(df, vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, v = b.column(0), b.column(1)
            cells, d = b.column(2).to_numpy(), b.column(3).to_numpy(zero_copy_only=False)
            n = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = v.flatten()  # without the null ones
            begin, dim = np.cumsum(n) - n, n.copy()
            if flat.null_count:
                dim[np.repeat(np.arange(len(n)), n)[flat.is_null().to_numpy(zero_copy_only=False)]] = 0
            numbers = flat.to_numpy(zero_copy_only=False).astype(kind, copy=False)
            order = np.lexsort((dim, cells))
            edge = np.flatnonzero((np.diff(cells[order]) != 0) | (np.diff(dim[order]) != 0)) + 1
            for part in np.split(order, edge):
                for s in range(0, len(part), limit):
                    g = part[s : s + limit]
                    m = numbers[begin[g][:, None] + np.arange(dim[g[0]])] if dim[g[0]] else numbers[:0]
                    held = pa.ListArray.from_arrays(pa.array([0, len(g)], pa.int32()), rows.take(pa.array(g)))
                    one = [pa.array([cells[g[0]]], pa.int32()), pa.array([dim[g[0]]], pa.int32()), held, pa.array([m.tobytes()], pa.binary()), pa.array([d[g].astype(float).tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(one, ["_cell", "dim", "rows", "m", "d"])

    schema = T.StructType().add("_cell", T.IntegerType()).add("dim", T.IntegerType()).add("rows", T.ArrayType(slim.schema["rows"].dataType)).add("m", T.BinaryType()).add("d", T.BinaryType())
    return slim.mapInArrow(run, schema)


def kind_of(df: DataFrame, vector: str) -> type:
    return np.float32 if df.schema[vector].dataType.elementType == T.FloatType() else np.float64


def may_lead(s: np.ndarray, top_k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of what may be among the ``top_k`` of a row of scores once they are exact and rounded."""
    k = min(top_k, s.shape[1])
    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    return np.nonzero((s >= (least - TIE)[:, None]) & (s > OUT))


def first_of_equal(row: np.ndarray, score: np.ndarray, place: np.ndarray, top_k: int) -> np.ndarray:
    """Of equal scores of a row those with the ``top_k`` smallest places: what else is equal comes after them in any ranking."""
    order = np.lexsort((place, -score, row))
    r, s = row[order], score[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
    return order[np.arange(len(r)) - start < top_k]


def places_of(ids: pa.Array) -> np.ndarray:
    """The place of each id in their order."""
    order = pc.array_sort_indices(ids, order="ascending", null_placement="at_start").to_numpy()
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def _summed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of paired rows, added from the first dimension to the last."""
    out = np.zeros(len(x))
    for j in range(min(x.shape[1], y.shape[1])):
        out += x[:, j] * y[:, j]
    return out


def _scores(q: np.ndarray, e: np.ndarray, near: np.ndarray | None, top_k: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of one pair of blocks: what may be among the best of a query."""
    with np.errstate(all="ignore"):
        nq, ne = np.sqrt(_summed(q, q)), np.sqrt(_summed(e, e))
        if q.shape[1] and q.shape[1] == e.shape[1]:
            s = q @ e.T
            s /= nq[:, None]
            s /= ne[None, :]
            s[np.isnan(s)] = np.inf
            s[np.ix_(nq == 0, np.isfinite(ne))] = NULL  # a product of lengths of 0
            s[np.ix_(np.isfinite(nq), ne == 0)] = NULL
        else:
            s = np.full((len(q), len(e)), NULL)
        if near is not None:
            s[~near] = OUT
        row, col = may_lead(s, top_k)
        exact = np.full(len(row), NULL)
        for a in range(0, len(row), 1 << 17):
            r, c = row[a : a + (1 << 17)], col[a : a + (1 << 17)]
            real = s[r, c] != NULL
            r, c = r[real], c[real]
            exact[a : a + (1 << 17)][real] = _summed(q[r], e[c]) / (nq[r] * ne[c])
    keep = first_of_equal(row, np.where(np.isnan(exact), np.inf, exact), place[col], top_k)
    return row[keep], col[keep], exact[keep]


def best_pairs(pairs: DataFrame, top_k: int, query_kind: type, row_kind: type, slack: float | None = None) -> DataFrame:
    """query, the fields of ``rows``, score: of each pair of blocks (asked, qdim, qm, and rows, dim, m) what may be among a query's ``top_k``.

    With ``slack`` a point counts only where | its d - the query's _dq | is at most the query's ``bound`` plus that (null: no bound).
    """
    small_batches(pairs.sparkSession)
    fields = pairs.schema["rows"].dataType.elementType.fields
    schema = T.StructType([T.StructField("query", pairs.schema["asked"].dataType.elementType["query"].dataType), *fields, T.StructField("score", T.DoubleType())])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked, qdim, qm, rows, dim, m, d = (b.column(k) for k in range(7))
            for i in range(b.num_rows):
                a, r = asked[i].values, rows[i].values
                q = np.frombuffer(qm[i].as_buffer(), query_kind).reshape(len(a), qdim[i].as_py()).astype(float)
                e = np.frombuffer(m[i].as_buffer(), row_kind).reshape(len(r), dim[i].as_py()).astype(float)
                near = None
                if slack is not None:
                    dq, bound = (a.field(k).to_numpy(zero_copy_only=False).astype(float) for k in ("_dq", "bound"))
                    near = np.isnan(bound)[:, None] | (np.abs(dq[:, None] - np.frombuffer(d[i].as_buffer(), float)) <= bound[:, None] + slack)
                row, col, score = _scores(q, e, near, top_k, places_of(r.field("doc")))
                at = pa.array(col)
                cols = [a.field("query").take(pa.array(row)), *(r.field(k).take(at) for k in names), pa.array(score, mask=score == NULL)]
                yield pa.RecordBatch.from_arrays(cols, ["query", *names, "score"])

    return pairs.select("asked", "qdim", "qm", "rows", "dim", "m", "d").mapInArrow(run, schema)


def small(blocks: DataFrame, column: str, limit: int) -> DataFrame:
    """Written blocks, with the mark for a broadcast where all of them are small."""
    size = blocks.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return F.broadcast(blocks) if size <= limit else blocks


def dense_best(queries: DataFrame, corpus: DataFrame, top_k: int) -> DataFrame:
    """query, doc, payload, score: of all points (doc, embedding, payload) those that may be among the ``top_k`` of a query (query, q) by cosine."""
    payload = [c for c in corpus.columns if c not in ("doc", "embedding")]
    rows = packed(spread(corpus), F.struct("doc", *payload), "embedding", ROWS)
    asked = packed(queries, F.struct("query"), "q", QUERIES).select(F.col("rows").alias("asked"), F.col("dim").alias("qdim"), F.col("m").alias("qm"))
    asked = small(stored(asked, "query-blocks"), "qm", MAX_BROADCAST_BYTES)
    return best_pairs(rows.crossJoin(asked), top_k, kind_of(queries, "q"), kind_of(corpus, "embedding"))
