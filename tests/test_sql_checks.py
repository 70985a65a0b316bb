"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import pytest

from torquelake.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def norm(v):
    return (None if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def db():
    import duckdb

    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["bus_summary", "id_freq_rolling", "window_stats", "window_stats_scaled", "calibrate_bilateral", "roc_auc", "repair_plan", "vin_decode", "isotp_reassemble", "uds_dispatch", "dbc_decode", "freeze_correlation", "bm25_topk", "bm25_stored_topk", "vector_index_topk", "rrf_hybrid", "hit_mrr_by_group", "corpus_violations", "bm25_all_documents", "agent_summary", "agent_repeat_total", "top_k_clamp", "parse_replies", "extraction_counters", "latency_p95", "agent_scores", "isotp_encode", "isotp_frame_count", "dtc_rejected", "signal_lookup"])
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    q = db.sql(registry.ORACLES[name])
    assert cols == sorted(q.columns)
    at = [q.columns.index(c) for c in cols]
    assert sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr) == sorted((tuple(norm(r[i]) for i in at) for r in q.fetchall()), key=repr)


def test_every_query_is_registered_with_sql_or_random():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"isolation_forest", "reconstruction_score"}
