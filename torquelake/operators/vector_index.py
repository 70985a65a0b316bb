"""Exact vector index: points stored by their nearest centre, cells and points left out by the triangle inequality.

The vectors are compared at length 1, where the cosine s and the distance d of two of them tell the same: d * d = 2 - 2 s.
A point p of the cell with centre c is at least |d(q, c) - d(p, c)| away from a query q. So a cell of which no point can be
nearer than the best found so far is not read for that query, and within a cell that is read the same test comes before the
cosine. The hits are those of a search over all points, ties included.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from torquelake.operators import blocks, retrieval
from torquelake.session import stored

#: Centres at most; they are held by every task (cells x dimensions numbers).
MAX_CELLS = 4096
#: Points that the centres are fitted on at most, chosen by a hash of their id. Every point is indexed.
MAX_FIT = 100_000
#: Visits (queries of a block and a cell) are broadcast up to this many bytes of query vectors, else joined by a shuffle on the cell.
MAX_BROADCAST_BYTES = 64 << 20
#: Scores this close count as equal in ``retrieval.rank``; distances carry rounding errors below the second number.
TIE, SLACK = 2e-9, 1e-6
#: Cell of the points without a direction (null, all zero, or not finite).
NOWHERE = -1


def _units(vectors: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors at length 1, which of them have a direction)."""
    v = np.zeros((len(vectors), dim))
    for k, x in enumerate(vectors):
        if x is not None:
            if len(x) != dim:
                raise ValueError(f"a vector has {len(x)} numbers, not {dim}")
            v[k] = x
    with np.errstate(over="ignore", invalid="ignore"):
        n = np.linalg.norm(v, axis=1)
    ok = np.isfinite(n) & (n > 0)
    v[~ok] = 0
    return v / np.where(ok, n, 1)[:, None], ok


def _distances(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (v * v).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * v @ centres.T
    return np.sqrt(np.maximum(square, 0))


def _square(vector: str) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def _fit(points: DataFrame, n: int, dim: int, cells: int, seed: int) -> np.ndarray:
    """Centres of k-means over at most about ``MAX_FIT`` points at length 1."""
    grid = 1 << 20
    share = min(grid, math.ceil(grid * MAX_FIT / max(n, 1)))
    length = F.sqrt(_square("embedding"))
    sample = points.where(F.pmod(F.xxhash64("doc"), F.lit(grid)) < share).withColumn("_n", length).where(f"_n > 0 AND _n < double('Infinity') AND size(embedding) = {dim}")
    unit = sample.select(array_to_vector(F.transform("embedding", lambda x: x.cast("double") / F.col("_n"))).alias("features"))
    unit = stored(blocks.spread(unit), "fit")  # read once for each step of k-means
    if unit.isEmpty():
        return np.zeros((0, 0))
    return np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(unit).clusterCenters())


class VectorIndex:
    """``points`` (doc, embedding, payload, _cell, _d: distance to the centre) in a folder for each cell, and one row per cell."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.points = spark.read.parquet(f"{self.folder}/points")
        self.cells = spark.read.parquet(f"{self.folder}/cells")
        rows = self.cells.where(F.col("_cell") != NOWHERE).orderBy("_cell").collect()  # MAX_CELLS at most
        self.ids = np.array([r["_cell"] for r in rows], np.int64)
        self.centres = np.array([r["centre"] for r in rows])
        self.counts, self.near, self.far = (np.array([r[c] for r in rows]) for c in ("n", "near", "far"))

    @classmethod
    def build(cls, points: DataFrame, folder: str, cells: int | None = None, seed: int = 7) -> VectorIndex:
        """Index all ``points`` (doc, embedding, payload). ``cells`` defaults to the square root of their number.

        A cell that holds many points (equal ones, say) is written by several tasks: rows are spread by ranges of (cell,
        distance, doc). Points without a direction are kept apart; a vector of another length raises. An empty table gives an
        index without cells.
        """
        spark, folder = points.sparkSession, folder.rstrip("/")
        first = points.where("embedding IS NOT NULL").select(F.size("embedding").alias("n")).head(1)
        n, dim = points.count(), first[0]["n"] if first else 1
        if cells is None:
            cells = round(math.sqrt(n))
        centres = _fit(points, n, dim, max(2, min(cells, MAX_CELLS)), seed)
        schema = points.withColumns({"_cell": F.lit(0), "_d": F.lit(0.0)}).schema

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                v, ok = _units(pdf["embedding"], dim)
                if len(centres) and len(pdf):
                    d = _distances(v, centres)
                    cell = d.argmin(1)
                    yield pdf.assign(_cell=np.where(ok, cell, NOWHERE).astype(np.int32), _d=np.where(ok, d[np.arange(len(d)), cell], 0.0))
                else:
                    yield pdf.assign(_cell=np.int32(NOWHERE), _d=0.0)

        placed = stored(points.mapInPandas(assign, schema), "vectors-placed")
        spread = placed.repartitionByRange("_cell", "_d", "doc").sortWithinPartitions("_cell", "_d")
        spread.write.partitionBy("_cell").parquet(f"{folder}/points")
        if n == 0:  # no folder of a cell tells the column
            placed.write.mode("overwrite").parquet(f"{folder}/points")
        named = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)] + [(NOWHERE, [])], "_cell int, centre array<double>")
        found = placed.groupBy("_cell").agg(F.count("*").alias("n"), F.min("_d").alias("near"), F.max("_d").alias("far"))
        found.join(F.broadcast(named), "_cell").write.parquet(f"{folder}/cells")
        return cls(spark, folder)

    def _visits(self, queries: DataFrame, top_k: int) -> DataFrame:
        """_cell, asked (query, bound, _dq), qdim, qm for the cells to read: up to ``blocks.QUERIES`` queries of a cell packed in a row.
        Where ``bound`` (a distance) is null: the nearest cells that hold ``top_k`` points; else the others that may hold a point within it."""
        ids, centres, counts, near, far = self.ids, self.centres, self.counts, self.near, self.far
        dim, kind, size = centres.shape[1], blocks.kind_of(queries, "q"), blocks.QUERIES
        one = T.StructType([queries.schema["query"], T.StructField("bound", T.DoubleType()), T.StructField("_dq", T.DoubleType())])
        schema = T.StructType().add("_cell", T.IntegerType()).add("asked", T.ArrayType(one)).add("qdim", T.IntegerType()).add("qm", T.BinaryType())

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (whole.slice(s, size) for whole in batches for s in range(0, whole.num_rows, size)):
                vectors = pd.Series(b.column(1).to_pylist(), dtype=object)
                v, ok = _units(vectors, dim)
                if not ok.any():
                    continue
                v, raw = v[ok], np.array(vectors[ok].tolist(), kind)
                query, bound = b.column(0).filter(pa.array(ok)), b.column(2).to_numpy(zero_copy_only=False).astype(float)[ok]
                d = _distances(v, centres)
                order = d.argsort(axis=1, kind="stable")
                held = np.cumsum(counts[order], axis=1) - counts[order]  # points in nearer cells
                first = np.zeros(d.shape, bool)
                np.put_along_axis(first, order, held < top_k, axis=1)
                within = np.maximum(np.maximum(d - far, near - d), 0) <= bound[:, None] + SLACK
                wanted = np.where(np.isnan(bound)[:, None], first, within & ~first)
                for cell in np.flatnonzero(wanted.any(0)):
                    g = np.flatnonzero(wanted[:, cell])
                    asked = pa.StructArray.from_arrays([query.take(pa.array(g)), pa.array(bound[g], mask=np.isnan(bound[g])), pa.array(d[g, cell])], ["query", "bound", "_dq"])
                    cols = [pa.array([ids[cell]], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(g)], pa.int32()), asked), pa.array([dim], pa.int32()), pa.array([raw[g].tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["_cell", "asked", "qdim", "qm"])

        blocks.small_batches(self.spark)
        return queries.select("query", "q", "bound").mapInArrow(visit, schema)

    def _scored(self, visits: DataFrame, top_k: int, kind: type) -> DataFrame:
        """query, doc, payload, score: of the points of the visited cells within the bound those that may be among a query's ``top_k``.

        Blocks of points and of visits meet by cell; a cell of many blocks is dealt to several tasks.
        """
        deals = F.broadcast(self.cells.select("_cell", F.ceil(F.col("n") / blocks.ROWS).cast("int").alias("_deals")))
        payload = [c for c in self.points.columns if c not in ("doc", "embedding", "_cell", "_d")]
        rows = blocks.packed(self.points, F.struct("doc", *payload), "embedding", blocks.ROWS, "_cell", "_d").join(deals, "_cell")
        rows = rows.withColumn("_deal", F.pmod(F.xxhash64("m"), "_deals").cast("int")).drop("_deals")
        visits = stored(visits, "visits").join(deals, "_cell").withColumn("_deal", F.explode(F.sequence(F.lit(0), F.col("_deals") - 1))).drop("_deals")
        near = blocks.small(visits, "qm", MAX_BROADCAST_BYTES)
        if near is visits:  # a number of its own, as a task's work does not follow its bytes
            tasks = 4 * self.spark.sparkContext.defaultParallelism
            rows, near = rows.repartition(tasks, "_cell", "_deal"), visits.repartition(tasks, "_cell", "_deal")
        both = rows.join(near, ["_cell", "_deal"])
        return blocks.best_pairs(both, top_k, kind, blocks.kind_of(self.points, "embedding"), SLACK)

    def _bounds(self, queries: DataFrame, top_k: int) -> tuple[DataFrame, DataFrame]:
        """(hits in the nearest cells, queries with the distance of the last of them)."""
        open_ = queries.select("query", "q").withColumn("bound", F.lit(None).cast("double"))
        kind = blocks.kind_of(queries, "q")
        best = stored(retrieval.rank(self._scored(self._visits(open_, top_k), top_k, kind), top_k=top_k), "first-hits")
        last = best.groupBy("query").agg(F.min("score").alias("s"))
        bound = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * (F.col("s") - TIE)))
        return best, queries.select("query", "q").join(last.select("query", bound.alias("bound")), "query")

    def search(self, queries: DataFrame, top_k: int = 5) -> DataFrame:
        """query, doc, payload, score, rank: the ``top_k`` points by cosine for a stated query set (query, q), as
        ``retrieval.rank`` orders them. Points without a direction are hits only where the index holds fewer than ``top_k``
        others, with a null score. A query without a direction has no hits."""
        if top_k < 1:
            raise ValueError("top_k must be at least 1")
        if self.counts.sum() < top_k:  # a handful of points with a direction; of the others the first ids
            rest = self.points.where(F.col("_cell") == NOWHERE).orderBy("doc").limit(top_k)
            few = self.points.where(F.col("_cell") != NOWHERE).unionByName(rest).drop("_cell", "_d")
            turned = lambda c: _square(c).between(sys.float_info.min, sys.float_info.max)
            scored = retrieval.dense_scores(queries.where(turned("q")), few.withColumn("_turned", turned("embedding")))
            return retrieval.rank(scored.withColumn("score", F.when(F.col("_turned"), F.col("score"))).drop("_turned"), top_k=top_k)
        best, bounded = self._bounds(queries, top_k)
        more = self._scored(self._visits(bounded, top_k), top_k, blocks.kind_of(queries, "q"))
        return retrieval.rank(best.drop("rank").unionByName(more), top_k=top_k)

    def work(self, queries: DataFrame, top_k: int = 5) -> DataFrame:
        """query, cells and points read of those that there are: what a search costs."""
        sizes = F.broadcast(self.cells.select("_cell", "n"))
        open_ = queries.select("query", "q").withColumn("bound", F.lit(None).cast("double"))
        _, bounded = self._bounds(queries, top_k)
        visits = self._visits(open_, top_k).unionByName(self._visits(bounded, top_k)).select("_cell", F.explode("asked.query").alias("query")).join(sizes, "_cell")
        return visits.groupBy("query").agg(F.count("*").alias("cells"), F.sum("n").alias("points"), F.lit(len(self.ids)).alias("of_cells"), F.lit(int(self.counts.sum())).alias("of_points"))
