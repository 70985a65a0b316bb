"""Stored indexes against a look at every row: same hits, fewer blocks and cells."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from torquelake.operators import inverted_index, retrieval, vector_index

DIM = 8


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, DIM))
    near = [(centres[k % 12] + r.normal(size=DIM) * 0.02) * r.uniform(0.5, 3) for k in range(600)]
    rows = [(k, [float(x) for x in v], f"p{k}") for k, v in enumerate(near)]
    rows += [(1000 + k, rows[7][1], "copy") for k in range(300)]  # a third of all rows are equal
    rows += [(2000, None, "null"), (2001, [0.0] * DIM, "zero"), (2002, [float("nan")] * DIM, "nan")]
    return spark.createDataFrame(rows, "doc long, embedding array<float>, label string")


def _ranks(df):
    return sorted((r["query"], r["rank"], r["doc"]) for r in df.collect())


@pytest.mark.parametrize("limit", [vector_index.MAX_BROADCAST_BYTES, 0])
def test_vector_index_gives_the_hits_of_a_full_search(spark, vectors, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(vector_index, "MAX_BROADCAST_BYTES", limit)
    index = vector_index.VectorIndex.build(vectors, f"file://{tmp_path}/index", cells=12)
    asked = vectors.where("doc % 50 = 7 OR doc IN (1003, 2000, 2001)").select(F.col("doc").alias("query"), F.col("embedding").alias("q"))
    real = vectors.where("doc < 2000")
    for k in (1, 5, 310):  # beyond the copies of one vector too
        want = retrieval.rank(retrieval.dense_scores(asked.where("query < 2000"), real), top_k=k)
        assert _ranks(index.search(asked, k)) == _ranks(want)
    assert index.search(asked, 5).columns == ["query", "doc", "label", "score", "rank"]
    assert vector_index.VectorIndex(spark, f"file://{tmp_path}/index").points.count() == 903
    work = index.work(asked, 5).collect()
    assert len(work) == asked.where("query < 2000").count()
    assert all(w["of_points"] == 900 and w["of_cells"] == 12 for w in work)
    assert sum(w["points"] for w in work) < sum(w["of_points"] for w in work) / 2


def test_vector_index_small_and_odd_tables(spark, vectors, tmp_path):
    few = vectors.where("doc < 2 OR doc >= 2000")
    index = vector_index.VectorIndex.build(few, f"file://{tmp_path}/few")
    asked = few.where("doc <= 1").select(F.col("doc").alias("query"), F.col("embedding").alias("q"))
    for q, got in ((0, [0, 1, 2000]), (1, [1, 0, 2000])):  # points without a direction fill up by id
        assert [r["doc"] for r in index.search(asked.where(f"query = {q}"), 3).orderBy("rank").collect()] == got
    empty = vector_index.VectorIndex.build(vectors.where("false"), f"file://{tmp_path}/none")
    assert empty.search(asked, 3).count() == 0
    with pytest.raises(ValueError):
        index.search(asked, 0)
    with pytest.raises(Exception, match="numbers, not"):
        vector_index.VectorIndex.build(vectors.where("doc < 5").union(spark.createDataFrame([(9, [1.0], "x")], vectors.schema)).coalesce(1), f"file://{tmp_path}/long")


@pytest.fixture(scope="module")
def texts(spark):
    r = np.random.default_rng(6)
    topic = lambda t, n: " ".join(f"t{t}w{int(x)}" for x in r.zipf(1.6, n) % 30)
    rows = [(k, f"the {topic(k % 20, 15 + 3 * (k % 20))} the") for k in range(900)]
    rows += [(2000 + k, rows[3][1]) for k in range(400)] + [(3000, None), (3001, ""), (3002, "!?"), (3003, "The " * 5000)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("limit", [inverted_index.MAX_BROADCAST_PAIRS, 0])
def test_inverted_index_gives_the_ranks_of_a_full_search(spark, texts, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(inverted_index, "MAX_BROADCAST_PAIRS", limit)
    index = inverted_index.InvertedIndex.build(texts, f"file://{tmp_path}/index")
    rows = [(1, "t3w1 t3w2 t3w2"), (2, "the t5w7"), (3, "nothing here"), (4, None), (5, "THE"), (6, "t3w1 t9w4 t11w2 the the")]
    asked = spark.createDataFrame(rows, "query_id long, text string")
    scores = retrieval.bm25_search(texts, asked)
    for k in (1, 5, 450):
        want, got = retrieval.rank(scores, top_k=k), index.search(asked, k)
        assert _ranks(got) == _ranks(want)
    best = {(r["query"], r["doc"]): r["score"] for r in scores.collect()}
    assert all(abs(best[r["query"], r["doc"]] - r["score"]) < 1e-9 for r in index.search(asked, 450).collect())
    again = inverted_index.InvertedIndex(spark, f"file://{tmp_path}/index")
    work = {w["query"]: w for w in again.work(asked, 1).collect()}
    assert set(work) == {1, 2, 5, 6} and all(w["blocks"] <= w["of_blocks"] for w in work.values())
    assert work[6]["blocks"] < work[6]["of_blocks"] / 2


def test_inverted_index_of_nothing(spark, texts, tmp_path):
    asked = spark.createDataFrame([(1, "the")], "query_id long, text string")
    for name, docs in (("none", texts.where("false")), ("blank", texts.where("doc_id IN (3000, 3001, 3002)"))):
        index = inverted_index.InvertedIndex.build(docs, f"file://{tmp_path}/{name}")
        assert index.search(asked, 3).count() == 0 and index.work(asked, 3).count() == 0
    with pytest.raises(ValueError):
        index.search(asked, 0)
