"""Results that hold at larger sizes too: wide numbers, many ties, bounded steps."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from torquelake.operators import agent, blocks, inverted_index, retrieval, text_blocks
from torquelake.plans import registry, vehicle_streams


def _documents(spark, folder, ids):
    rows = [(i, f"text {i}", "en") for i in ids]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"file://{folder}/documents.parquet")


def _sql(folder, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return sorted(map(repr, c.sql(registry.ORACLES[name]).fetchall()))


def test_cases_of_ids_over_four_digits(spark, tmp_path):
    _documents(spark, tmp_path, [0, 1, 5, 65_535, 65_536, 1_048_577, 70_000, 99_991])
    for name in ("corpus_flatten", "corpus_violations"):
        got = registry.QUERIES[name](spark, f"file://{tmp_path}").collect()
        assert sorted(repr(tuple(r)) for r in got) == _sql(tmp_path, name)


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(11)
    rows = [(k, [float(x) for x in r.normal(size=6)], k % 7) for k in range(400)]
    rows += [(1000 + k, rows[3][1], 1) for k in range(200)] + [(2000 + k, [2 * x for x in rows[3][1]], 2) for k in range(50)]
    rows += [(3000, None, 3), (3001, [0.0] * 6, 3), (3002, [float("nan")] * 6, 3), (3003, [1.0, None, 0.0, 0.0, 0.0, 0.0], 3), (3004, [], 3)]
    return spark.createDataFrame(rows, "doc long, embedding array<float>, label int")


@pytest.mark.parametrize("limit", [blocks.MAX_BROADCAST_BYTES, -1])
def test_dense_topk_by_blocks_is_a_look_at_every_pair(spark, points, monkeypatch, limit):
    monkeypatch.setattr(blocks, "MAX_BROADCAST_BYTES", limit)
    monkeypatch.setattr(blocks, "ROWS", 64)
    asked = points.where("doc % 20 = 3 OR doc >= 3000").select(F.col("doc").alias("query"), F.col("embedding").alias("q"))
    scores = retrieval.dense_scores(asked, points)
    for k in (1, 5, 300):  # beyond the copies of one vector too
        want, got = retrieval.rank(scores, top_k=k), retrieval.dense_topk(asked, points, k)
        assert got.columns == ["query", "doc", "label", "score", "rank"]
        rows = [sorted((r["query"], r["rank"], r["doc"], r["label"], repr(r["score"])) for r in d.collect()) for d in (want, got)]
        assert rows[0] == rows[1]


def test_dense_queries_make_no_row_for_each_pair(spark, tmp_path, points, monkeypatch):
    points.withColumnRenamed("doc", "vec_id").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(retrieval, "dense_scores", None)
    for name in ("dense_topk", "dense_dedup", "hit_mrr", "hit_mrr_by_group"):
        assert registry.QUERIES[name](spark, f"file://{tmp_path}").count()


def test_bm25_by_blocks_is_a_score_of_every_pair(spark, monkeypatch):
    monkeypatch.setattr(text_blocks, "ROWS", 64)
    monkeypatch.setattr(text_blocks, "STEP", 500)
    r = np.random.default_rng(3)
    rows = [(k, " ".join(f"w{int(x)}" for x in r.zipf(1.5, 20 + k % 30) % 60) + (" half" if k % 2 else "")) for k in range(300)]
    rows += [(1000 + k, rows[4][1]) for k in range(100)] + [(2000, None), (2001, ""), (2002, "half only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(1, rows[4][1]), (2, "w1 w1 w7 HALF"), (3, "nothing"), (4, None), (5, "half")], "query_id long, text string")
    scores = retrieval.bm25_search(docs, asked).persist()
    shape = lambda d: sorted((x["query"], x["rank"], x["doc"], round(x["score"], 8)) for x in d.collect())
    for k in (3, 150):
        assert shape(retrieval.bm25_topk(docs, asked, k)) == shape(retrieval.rank(scores, top_k=k))
    every = retrieval.all_topk(scores, asked.select(F.col("query_id").alias("query")), docs.select(F.col("doc_id").alias("doc")), 5)
    assert shape(retrieval.bm25_topk(docs, asked, 5, every=True)) == shape(every)
    got = {x["query"]: (x["n_docs"], round(x["best"], 7), round(x["total"], 6)) for x in retrieval.bm25_totals(docs, asked).collect()}
    want = scores.groupBy("query").agg(F.count("*").alias("n"), F.max("score").alias("b"), F.sum("score").alias("t")).collect()
    assert got == {x["query"]: (x["n"], round(x["b"], 7), round(x["t"], 6)) for x in want}


def test_stored_search_makes_no_row_for_each_query_block_and_term(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_blocks, "ROWS", 256)
    made, stored = [], inverted_index.stored
    monkeypatch.setattr(inverted_index, "stored", lambda df, name, **o: made.append(stored(df, name, **o)) or made[-1])
    r = np.random.default_rng(8)
    text = lambda n: " ".join(f"w{int(x)}" for x in r.zipf(1.4, n) % 50)
    docs = spark.createDataFrame([(k, text(20 + k % 40)) for k in range(1600)], "doc_id long, text string")  # 50 blocks and more
    asked = spark.createDataFrame([(k, text(15)) for k in range(40)], "query_id long, text string")
    index = inverted_index.InvertedIndex.build(docs, f"file://{tmp_path}/index")
    made.clear()
    got = index.search(asked, 5)
    want = retrieval.rank(retrieval.bm25_search(docs, asked), top_k=5)
    shape = lambda d: sorted((x["query"], x["rank"], x["doc"], round(x["score"], 8)) for x in d.collect())
    assert shape(got) == shape(want)
    assert max(d.count() for d in made) <= 2 * 40


def test_long_texts_are_indexed_by_all_tasks(spark, tmp_path, monkeypatch):
    made, stored = {}, inverted_index.stored
    monkeypatch.setattr(inverted_index, "stored", lambda df, name, **o: made.setdefault(name, stored(df, name, **o)))
    docs = spark.createDataFrame([(k, "w " * (2000 if k % 10 == 0 else 20)) for k in range(1600)], "doc_id long, text string")  # a tenth of the rows has nearly all words
    docs = docs.withColumn("text", F.concat("text", F.lit("n"), "doc_id"))
    inverted_index.InvertedIndex.build(docs, f"file://{tmp_path}/index")
    words = made["text-blocks"].select(F.input_file_name().alias("f"), F.explode("dl").alias("n")).groupBy("f").agg(F.sum("n").alias("n")).collect()
    assert max(w["n"] for w in words) < sum(w["n"] for w in words) / 3


def test_slices_of_a_stream_hold_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vehicle_streams, "SLICE_ROWS", 50)
    ids = [*range(400), *range(100_000, 100_100)]  # most of them in a small part of their span
    e = spark.createDataFrame([(i,) for i in ids], "event_id long").selectExpr("event_id", "timestamp_seconds(event_id) AS ts", "event_id % 30 AS user_id", "'x' AS event_type", "1.0D AS value")
    e.write.parquet(f"file://{tmp_path}/events.parquet")
    parts = [[r[0] for r in s.select("event_id").collect()] for s in vehicle_streams._bus_slices(spark, f"file://{tmp_path}")]
    assert sorted(sum(parts, [])) == ids and all(max(a) < min(b) for a, b in zip(parts, parts[1:]))
    assert len(parts) > 3


def test_turns_broadcast_no_script(spark):
    runs = spark.range(20).selectExpr("id AS run_id", "'q' AS input")
    script = runs.selectExpr("run_id", "1 AS turn", "'done' AS content", "CAST(NULL AS string) AS tool", "'{}' AS arguments")
    step = agent.scripted(script)(runs.selectExpr("run_id", "input AS history", "1 AS turn"))
    assert step.count() == 20 and "Broadcast" not in step._jdf.queryExecution().executedPlan().toString()
