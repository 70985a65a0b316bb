"""Vector collection, hybrid search, tools, dialogue, evaluation, models, sinks and the command line, on small made-up data."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from torquelake import cli
from torquelake.functions import dims
from torquelake.operators import agent, detect, dialogue, evaluate, forest, quantiles, retrieval, runners, signals, tools, vectors, windows
from torquelake.sources import corpus

CASES = [
    {"id": "case-001", "dtc_codes": ["P0420"], "brands": ["Kia"], "engine_family": "G4", "system": "exhaust", "symptoms_fr": "voyant allumé", "symptoms_en": "engine light on", "root_cause_fr": "catalyseur usé", "root_cause_en": "worn catalyst", "fix_fr": "remplacer", "fix_en": "replace the catalyst", "confirmed": True},
    {"id": "case-002", "dtc_codes": ["P0300"], "brands": ["Kia"], "engine_family": "G4", "system": "ignition", "symptoms_fr": "à-coups", "symptoms_en": "rough idle misfire", "root_cause_fr": "bobine", "root_cause_en": "bad coil", "fix_fr": "changer", "fix_en": "new coil", "confirmed": True},
    {"id": "case-003", "dtc_codes": ["U0100"], "brands": ["VW"], "engine_family": "EA", "system": "bus", "symptoms_fr": "panne", "symptoms_en": "no communication", "root_cause_fr": "faisceau", "root_cause_en": "loose harness", "fix_fr": "réparer", "fix_en": "repair the harness", "confirmed": True},
]


@pytest.fixture(scope="module")
def cases(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("kb") / "cases.json"
    p.write_text(json.dumps({"schema_version": 1, "cases": CASES}))
    return corpus.load_cases(spark, str(p))


def _model():
    def load():  # inner functions travel to the workers by value
        import numpy as np

        def embed(texts):
            v = np.zeros((len(texts), 16), np.float32)
            for k, t in enumerate(texts):
                for w in t.lower().replace(":", " ").replace(".", " ").split():
                    v[k, sum(map(ord, w)) % 16] += 1
            return v

        return embed

    return load


model = _model()


def test_load_cases_raises(spark, tmp_path):
    for name, body in (("empty", {"cases": []}), ("broken", {"cases": [CASES[0] | {"dtc_codes": ["XX"]}]})):
        p = tmp_path / f"{name}.json"
        p.write_text(json.dumps(body))
        with pytest.raises(ValueError):
            corpus.load_cases(spark, str(p))


def test_queries_and_scenarios(spark, tmp_path):
    def put(body) -> str:
        p = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        p.write_text(json.dumps(body))
        return str(p)

    asked = {"id": "a", "lang": "en", "query": "coil", "relevant_cases": ["case-002"]}
    got = corpus.load_queries(spark, put({"schema_version": 1, "description": "", "queries": [asked, asked | {"id": "b"}]})).collect()
    assert [(r.query_id, r.text, r.lang, r.expected_cases) for r in got] == [(k, "coil", "en", ["case-002"]) for k in "ab"]
    scenario = {"id": "s", "type": "trap", "input": "why", "expected_tools": [], "must_decline": True}
    for body in ([scenario], {"scenarios": [scenario]}):
        (r,) = corpus.load_scenarios(spark, put(body)).collect()
        assert (r.run_id, r.type, r.question, r.expected_tools, r.expected_cases, r.must_decline) == ("s", "trap", "why", [], [], True)
    for load, body in ((corpus.load_queries, {"queries": []}), (corpus.load_queries, {"queries": [{"query_id": "a", "text": "coil"}]}), (corpus.load_scenarios, {"scenarios": [{"run_id": "r", "question": "why"}]}), (corpus.load_scenarios, [])):
        with pytest.raises(ValueError):
            load(spark, put(body))


def test_agent_summary_leaves_degraded_runs_out(spark):
    good = {"run_id": "b", "answer": "see case-1", "tools_used": ["t"], "expected_tools": ["t"], "cases_grounded": ["case-1"], "expected_cases": ["case-1"], "expected_keywords": ["see"], "must_decline": False, "latency_ms": 5.0}
    bad = good | {"run_id": "a", "answer": dims.DEGRADED_PREFIX, "tools_used": [], "cases_grounded": [], "latency_ms": 900.0}
    warm = good | {"run_id": "c", "latency_ms": 7.0}
    schema = "run_id string, answer string, tools_used array<string>, expected_tools array<string>, cases_grounded array<string>, expected_cases array<string>, expected_keywords array<string>, must_decline boolean, latency_ms double"
    rows = lambda *r: agent.score_scenarios(spark.createDataFrame([tuple(x[c.split()[0]] for c in schema.split(", ")) for x in r], schema))
    (s,) = evaluate.agent_summary(rows(good, bad, warm)).collect()
    assert (s.n, s.degraded, s.degraded_ids, s.tools_exact, s.case_recall, s.citations_grounded, s.keyword_coverage) == (2, 1, ["a"], 1.0, 1.0, 1.0, 1.0)
    assert (s.cold_ms, s.warm_mean_ms, s.warm_median_ms, s.decline_rate) == (5.0, 7.0, 7.0, None)
    (s,) = evaluate.agent_summary(rows(bad)).collect()
    assert (s.n, s.degraded, s.tools_exact, s.warm_median_ms) == (0, 1, None, None)


@pytest.mark.parametrize("few,fan", [(10_000, 4096), (3, 4)])
def test_quantiles_without_a_sort(spark, few, fan):
    r = np.random.default_rng(fan)
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 2), ("c", 500), (None, 40)) for v in np.round(r.normal(size=n) * 10.0 ** r.integers(-3, 3), 2)]
    rows += [("c", 1.5)] * 300 + [("c", None), ("d", None), ("e", -1.7e308), ("e", 1.7e308), ("e", 0.0), ("c", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    qs = {"q0": 0.0, "q1": 0.01, "q5": 0.5, "q98": 0.98, "q100": 1.0}
    want = {g: [np.percentile([v for k, v in rows if k == g and v is not None and v == v], 100 * q) for q in qs.values()] for g in ("a", "b", "c", None)}
    got = {x.g: [x[k] for k in qs] for x in quantiles.exact(df, "v", qs, ["g"], few, fan).collect()}
    assert set(got) == {"a", "b", "c", "e", None} and got["e"][2] == 0.0
    assert all(np.allclose(got[g], w, rtol=1e-12) for g, w in want.items())
    assert quantiles.exact(df.where("false"), "v", qs).collect()[0].asDict() == dict.fromkeys(qs)
    assert quantiles.exact(df.where("g = 'c'"), "v", {"m": 0.5}, None, few, fan).first().m == pytest.approx(want["c"][2])


def test_answer_loop(spark):
    call = {"tool_calls": [{"function": {"name": "decode_dtc", "arguments": '{"code": "P0420"}'}}]}
    result, trace = dialogue.answer(spark, "why?", [call, call, {"content": "read case-1"}], lambda name, args: f"{name}:{args['code']}")
    assert result == {"answer": "read case-1", "stop_reason": "answered", "turns": 3, "tools_used": ["decode_dtc"], "cases_cited": ["case-1"], "hit_turn_limit": False}
    assert [t["repeated"] for t in trace] == [False, True] and trace[1]["result"].startswith("Notice")
    assert dialogue.answer(spark, "why?", [call], lambda *a: "x", 2)[0]["hit_turn_limit"]
    with pytest.raises(ValueError):
        dialogue.answer(spark, "  ", [], None)


def test_retrieval_evaluation(spark, tmp_path):
    hits = spark.createDataFrame([("a", "q1", "x", 1), ("a", "q2", "n", 1), ("b", "q1", "n", 1), ("b", "q1", "x", 2), ("b", "q2", "n", 1)], "system string, query string, item string, rank int")
    rel = spark.createDataFrame([("q1", "x"), ("q2", "y")], "query string, item string")
    rows = evaluate.per_query(hits, rel, ["a", "b"])
    assert evaluate.per_query(hits, rel, ["a", "none"]).where("system = 'none' AND first_rank IS NULL").count() == 2
    assert {(r.system, r["query"]): r.first_rank for r in rows.collect()} == {("a", "q1"): 1, ("b", "q1"): 2, ("a", "q2"): None, ("b", "q2"): None}
    assert evaluate.failures(rows).count() == 2
    assert [tuple(r) for r in evaluate.divergence(rows).collect()] == [("q1", ["a"])]
    p = evaluate.write_json(str(tmp_path / "r/e.json"), retrieval.hit_metrics(rows), rows=rows)
    assert json.loads(p.read_text())["summary"]["n"] == 4
    assert evaluate.markdown_table(evaluate.failures(rows).orderBy("system")).count("\n") == 4


def test_retry_degraded(spark):
    runs = spark.createDataFrame([("a", "x", True), ("b", "y", False)], "run_id string, answer string, degraded boolean")
    got = evaluate.retry_degraded(runs, lambda d: d.withColumn("answer", F.lit("again")))
    assert {r.run_id: r.answer for r in got.collect()} == {"a": "again", "b": "y"}


def stats(spark, n=400, bad=(300, 340)):
    rows = [(i, f"{i % 5:X}", 8, [(i * k) % 7 if not bad[0] <= i < bad[1] else 250 for k in range(8)], i / 100, int(bad[0] <= i < bad[1])) for i in range(n)]
    return spark.createDataFrame(rows, "frame_idx long, can_id string, dlc int, data array<int>, timestamp double, label int")


def test_models(spark, tmp_path):
    frames = stats(spark, 1600, (1300, 1500))
    train, test = runners.prepare(frames)
    normal = train.where("y = 0")
    trees = forest.fit(normal, runners.STATS, trees=30)
    assert forest.rows_of(trees[0]) == normal.count() < forest.SAMPLE
    for scorer, rule in ((lambda a, b: forest.score(b, trees, runners.STATS), "upper"), (runners.reconstruction, "bilateral")):
        scored = scorer(normal, test).toPandas()
        assert scored[scored.y == 1].score.mean() > scored[scored.y == 0].score.mean()
        assert runners.evaluate(train, test, scorer, rule).first().auc > 0.9
    # 2^(-path / c): the mean path over all rows of one tree's own sample is about c
    assert 0.3 < forest.score(normal, trees, runners.STATS).agg(F.avg("score")).first()[0] < 0.6
    forest.save(trees, runners.STATS, {"high": 0.6}, str(tmp_path / "m/model.json"))
    again, cols, limits = forest.load(str(tmp_path / "m/model.json"))
    assert cols == runners.STATS and limits == {"high": 0.6} and all((a == b).all() for a, b in zip(again, trees, strict=True))
    got = runners.benchmark({"one": frames}, {"reconstruction": (runners.reconstruction, "bilateral")}).collect()
    assert [(r.dataset, r.model) for r in got] == [("one", "reconstruction")]


def test_reconstruction_error(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0), (0, 3.0, 3.0), (1, 2.0, 4.0)], "window_id long, a double, b double")
    assert {r.window_id: r.score for r in detect.reconstruction_error(df, [("a", "b")]).collect()} == {0: 0.5, 1: 4.0}


def test_exact_window_moments(spark):
    df = spark.createDataFrame([(0, x, 0) for x in (1, 2, 2, 5)], "window_id long, v long, label int")
    r = windows.window_stats(df, ["v"]).first()
    assert (r.v_mean, r.v_min, r.v_max) == (2.5, 1, 5) and abs(r.v_std - np.std([1, 2, 2, 5])) < 1e-12


def test_signal_sinks(spark, tmp_path):
    s = spark.createDataFrame([(0, 0.0, "d", "m", "1", "rpm", 800.0), (1, 0.1, "d", "m", "1", "rpm", 900.0), (1, 0.1, "d", "m", "1", "temp", 90.0)], "frame_idx long, timestamp double, dbc string, message string, can_id string, signal string, value double")
    assert tuple(signals.extraction_counters(s).first()) == (2, 1, 2, 3)
    out = signals.export(s, f"file://{tmp_path}/x")
    loaded, state = signals.load_signals(spark, out["signals"])
    assert loaded.count() == 3 and state == {"available": True, "error": None}
    assert [r.signal for r in spark.read.option("header", True).csv(out["summary"]).collect()] == ["rpm", "temp"]
    assert signals.load_signals(spark, f"file://{tmp_path}/none") == (None, {"available": False, "error": None})
    spark.range(2).write.parquet(f"file://{tmp_path}/other")
    assert signals.load_signals(spark, f"file://{tmp_path}/other")[1]["error"]


def test_diagnose(spark, tmp_path, capsys, monkeypatch):
    p = tmp_path / "cases.json"
    p.write_text(json.dumps({"cases": CASES}))
    monkeypatch.setattr("torquelake.session.build_session", lambda *a, **b: spark)
    assert cli.main(["diagnose", "P0420", "worn", "catalyst", "--trace", "--cases", str(p)]) == 0
    said = capsys.readouterr().out
    assert "Trouble code P0420" in said and "[case-001]" in said
    assert cli.main(["diagnose", "P0420", "--max-turns", "1"]) == 1
    assert cli.main(["diagnose", " "]) == 2
    assert cli.main(["scan", "--json", "--no-save", "--lang", "fr"]) == 0
