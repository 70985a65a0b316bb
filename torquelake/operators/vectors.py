"""A vector collection as a Parquet table: created if missing, checked and idempotent upserts, exact search, an injected embedding model."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from torquelake.operators import retrieval
from torquelake.sources import corpus

# Prefixes that the embedding model was trained with, and the namespace of point ids.
PREFIX = {"query": "query: ", "passage": "passage: "}
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
BATCH = 32


def prefixed(text: Column, kind: str) -> Column:
    """Queries are stripped, passages stay as they are."""
    return F.concat(F.lit(PREFIX[kind]), F.btrim(text, F.lit(" \t\n\r\f\x0b")) if kind == "query" else text)


def encode(df: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "text", kind: str = "passage") -> DataFrame:
    """Adds ``embedding``, normalised to length 1. ``load`` makes the model once a task; it maps a list of texts to an array."""
    schema = df.withColumn("embedding", F.array().cast("array<float>")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in batches:
            model = model or load()
            texts = pdf["_text"].tolist()
            parts = [np.asarray(model(texts[k : k + BATCH]), np.float32) for k in range(0, len(texts), BATCH)]
            v = np.concatenate(parts) if parts else np.zeros((0, 1), np.float32)
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield pdf.drop(columns="_text").assign(embedding=list(v))

    return df.withColumn("_text", prefixed(F.coalesce(F.col(text), F.lit("")), kind)).mapInPandas(run, schema)


class Collection:
    """Points (point_id, doc_id, embedding and payload columns) under one folder; every write makes a new version beside the old."""

    def __init__(self, spark: SparkSession, folder: str, dim: int):
        if dim < 1:
            raise ValueError("dim must be positive")
        self.spark, self.folder, self.dim = spark, folder.rstrip("/"), dim
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = lambda p: hadoop.Path(p)
        self._fs = hadoop.Path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[str]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        found = [s.getPath().toString() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted(p for p in found if self._fs.exists(self._path(f"{p}/_SUCCESS")))

    def exists(self) -> bool:
        return bool(self._versions())

    def ensure(self, payload: str = "") -> Collection:
        """Create an empty collection if there is none; ``payload``: its further columns."""
        if not self.exists():
            schema = "point_id string, doc_id string, embedding array<float>" + (f", {payload}" if payload else "")
            self._write(self.spark.createDataFrame([], schema))
        return self

    def _write(self, df: DataFrame) -> None:
        old = self._versions()
        df.write.parquet(f"{self.folder}/v{len(old) and int(old[-1].rsplit('/v', 1)[1][:9]) + 1:09d}-{uuid.uuid4().hex}")
        for p in old[:-1]:  # the version just replaced stays for its readers
            self._fs.delete(self._path(p), True)

    def read(self) -> DataFrame:
        if not self.exists():
            raise FileNotFoundError(f"no collection in {self.folder}")
        return self.spark.read.parquet(self._versions()[-1])

    def count(self) -> int:
        return self.read().count()

    def upsert(self, points: DataFrame) -> int:
        """Points by doc_id, the same id again replaces; raises on a missing or wrongly long vector. Returns the number of different points given."""
        bad = points.where(F.col("doc_id").isNull() | F.col("embedding").isNull() | (F.size("embedding") != self.dim))
        if first := bad.select("doc_id", F.size("embedding").alias("n")).head(1):
            raise ValueError(f"point {first[0].doc_id!r} has {first[0].n} numbers, not {self.dim}")
        named = points.withColumn("point_id", corpus.point_id(NAMESPACE, F.col("doc_id")))
        one = named.groupBy("point_id").agg(F.max(F.struct(*[c for c in named.columns if c != "point_id"])).alias("r")).select("point_id", "r.*")
        old = self.read()
        merged = old.join(one.select("point_id"), "point_id", "left_anti").unionByName(one, allowMissingColumns=True)
        self._write(merged)
        return one.count()

    def search(self, queries: DataFrame, top_k: int = 5) -> DataFrame:
        """query, doc, score, rank: exact cosine of a stated query set (query, q) with every point."""
        if top_k < 1:
            raise ValueError("top_k must be at least 1")
        points = self.read().withColumnRenamed("doc_id", "doc").drop("point_id")
        return retrieval.dense_topk(queries, points, top_k)


def build_index(collection: Collection, cases: DataFrame, load: Callable, question: str, top_k: int = 3) -> tuple[int, DataFrame]:
    """Flatten, embed and store the cases, then ask one question: (points stored, hits)."""
    n = collection.ensure("case_id string, lang string").upsert(encode(corpus.flatten(cases).select("doc_id", "case_id", "lang", "text"), load).drop("text"))
    asked = encode(collection.spark.createDataFrame([("smoke", question)], "query string, text string"), load, kind="query")
    return n, collection.search(asked.select("query", F.col("embedding").alias("q")), top_k)


class Retriever:
    """Postings and points of one corpus, kept in Spark's cache while open."""

    def __init__(self, cases: DataFrame, collection: Collection | None = None, embed: Callable[[DataFrame], DataFrame] | None = None):
        self.docs = corpus.flatten(cases).persist()
        if self.docs.isEmpty():
            self.docs.unpersist()
            raise ValueError("the corpus holds no document")
        self.postings, self.lengths = retrieval.bm25_index(self.docs)
        self.postings = self.postings.persist()
        self.collection, self.embed = collection, embed

    def search(self, queries: DataFrame, top_k: int = 5) -> DataFrame:
        """query, case_id, score, rank: lexical, fused with dense ranks where there is a collection. Raises on an empty query."""
        n = retrieval.overfetch(top_k)
        if bad := queries.where(F.coalesce(F.btrim("text", F.lit(" \t\n\r\f\x0b")), F.lit("")) == "").select("query_id").head(1):
            raise ValueError(f"query {bad[0].query_id!r} is empty")
        case = self.docs.select(F.col("doc_id").alias("doc"), "case_id")
        best = retrieval.all_topk(retrieval.bm25_scores(self.postings, queries), queries.select(F.col("query_id").alias("query")), self.lengths, n)
        lexical = retrieval.best_per_case(best.join(case, "doc"), "case_id", top_k)
        if self.collection is None:
            return lexical.select("query", "case_id", "score", "rank")
        asked = self.embed(queries).select(F.col("query_id").alias("query"), F.col("embedding").alias("q"))
        dense = retrieval.best_per_case(self.collection.search(asked, n).drop("case_id").join(case, "doc"), "case_id", top_k)
        return retrieval.rrf(dense, lexical, "case_id", top_k).select("query", "case_id", "score", "rank")

    def close(self) -> None:
        self.postings.unpersist()
        self.docs.unpersist()
