"""Command line: scan, decode-vin, analyze-can, diagnose, evaluate-retrieval, train-anomaly, version."""

from __future__ import annotations

import argparse
import json
import os
import re
import sys

from torquelake.functions import dims

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="torquelake")
    sub = p.add_subparsers(dest="command")
    s = sub.add_parser("scan", help="diagnostic report of the demonstration unit")
    s.add_argument("--signals", help="Parquet of decoded signals")
    s.add_argument("--out", default="reports")
    s.add_argument("--no-save", action="store_true")
    s.add_argument("--lang", choices=["fr", "en"], default="en")
    s.add_argument("--json", action="store_true", help="print the report as JSON")
    d = sub.add_parser("diagnose", help="answer a question with the tools, by scripted replies")
    d.add_argument("question", nargs="+")
    d.add_argument("--trace", action="store_true")
    d.add_argument("--model", default="scripted", help="a JSON list of replies, or scripted")
    d.add_argument("--max-turns", type=int, default=5)
    d.add_argument("--cases", help="repair cases as JSON")
    v = sub.add_parser("decode-vin")
    v.add_argument("vin")
    c = sub.add_parser("analyze-can")
    c.add_argument("log")
    c.add_argument("--brand")
    c.add_argument("--dbc-dir", default="dbc")
    c.add_argument("--rows", type=int, default=100_000, help="lines to read, from the first")
    c.add_argument("--out", default="results", help="folder of the decoded signals and their summary")
    e = sub.add_parser("evaluate-retrieval", help="hit rates of the lexical search over a query file")
    e.add_argument("cases", help="repair cases as JSON")
    e.add_argument("queries", help="queries with their relevant cases as JSON")
    e.add_argument("--out", default="results/retrieval_eval.json")
    e.add_argument("--top-k", type=int, default=5)
    t = sub.add_parser("train-anomaly", help="train and judge the recurrent model on a bus log")
    t.add_argument("log")
    t.add_argument("--rows", type=int, default=500_000)
    t.add_argument("--out", default="results")
    t.add_argument("--run", help="folder of the training run, to go on after a stop")
    for name, kind, default in (("window-size", int, 64), ("stride", int, 32), ("epochs", int, 10), ("batch-size", int, 128), ("lr", float, 1e-3), ("hidden-size", int, 64), ("latent-size", int, 16), ("low-percentile", float, 1.0), ("high-percentile", float, 99.0), ("seed", int, 42)):
        t.add_argument(f"--{name}", type=kind, default=default)
    sub.add_parser("version")
    return p


def replies_for(question: str) -> list[dict]:
    """The scripted plan: decode the first trouble code or vehicle number in the question, search the cases, answer."""
    call = lambda tool, **args: {"tool_calls": [{"function": {"name": tool, "arguments": json.dumps(args)}}]}
    plan = [call("decode_dtc", code=m[0]) for m in [re.search(r"(?i)\b[pcbu][0-9a-f]{4}\b", question)] if m]
    plan += [call("decode_vin", vin=m[0]) for m in [re.search(r"(?i)\b[a-hj-npr-z0-9]{17}\b", question)] if m]
    return [*plan, call("search_repair_cases", query=question), {"content": "See the findings of the tools above."}]


def diagnose(spark, a: argparse.Namespace) -> int:
    """0 with an answer, 1 at the turn limit, 2 for an empty question or an unreadable model or case file."""
    from torquelake.operators import dialogue, tools, vectors
    from torquelake.sources import corpus

    question = " ".join(a.question)
    try:
        retriever = vectors.Retriever(corpus.load_cases(spark, a.cases)) if a.cases else None
        script = replies_for(question) if a.model == "scripted" else json.loads(open(a.model, encoding="utf-8").read())
        result, trace = dialogue.answer(spark, question, script, lambda name, args: tools.call(spark, name, args, retriever), a.max_turns)
    except Exception as e:  # noqa: BLE001 - the command reports and ends
        print(f"cannot diagnose: {e}", file=sys.stderr)
        return 2
    for t in trace if a.trace else trace[-1:]:
        print(f"[{t['step']}] {t['tool']} {t['arguments']}\n{t['result']}")
    print(result["answer"])
    return 1 if result["hit_turn_limit"] else 0


def analyze_can(spark, a: argparse.Namespace) -> int:
    """0 with a decoded log, 1 if no definition file knows an identifier of it."""
    from torquelake.operators import signals
    from torquelake.operators.tools import analyze_can_log
    from torquelake.sources import dbc, frames

    print(analyze_can_log(spark, a.log, a.rows))
    if not os.path.isdir(a.dbc_dir):
        return 0
    defs = dbc.read_dbc(spark, a.dbc_dir, dims.BRAND_GLOBS[a.brand.lower()] if a.brand else "*.dbc")
    normal = frames.read_variable(spark, a.log, a.rows).where("label = 0")
    best = signals.best_dbc(signals.coverage(normal, defs)).first()
    if best is None or not best.matched:
        print("no definition file knows this log", file=sys.stderr)
        return 1
    found = signals.decode(normal, defs.where(defs.dbc == best.dbc))
    n = signals.extraction_counters(found).first()
    print(f"definitions: {best.dbc} ({best.coverage_percent} %)\nframes decoded: {n.frames_decoded}\nmessages: {n.messages}\nsignals: {n.signals}\ndata points: {n.datapoints}")
    if not a.brand:
        print(*signals.export(found, os.path.abspath(a.out)).values(), sep="\n")
    return 0


def evaluate_retrieval(spark, a: argparse.Namespace) -> int:
    """Hit rates and ranks by language, written as JSON; 2 for an unreadable case or query file."""
    from pyspark.sql import functions as F

    from torquelake.operators import evaluate, retrieval, vectors
    from torquelake.sources import corpus

    try:
        cases, queries = corpus.load_cases(spark, a.cases), corpus.load_queries(spark, a.queries)
    except Exception as e:  # noqa: BLE001 - the command reports and ends
        print(f"cannot evaluate: {e}", file=sys.stderr)
        return 2
    retriever = vectors.Retriever(cases)
    hits = retriever.search(queries, a.top_k).select(F.lit("bm25").alias("system"), "query", F.col("case_id").alias("item"), "rank")
    relevant = queries.select(F.col("query_id").alias("query"), F.explode("expected_cases").alias("item"))
    rows = evaluate.per_query(hits, relevant, ["bm25"], a.top_k).join(queries.select(F.col("query_id").alias("query"), "lang"), "query")
    by_lang = retrieval.hit_metrics(rows, "lang").where("lang IS NOT NULL")
    print(evaluate.markdown_table(retrieval.hit_metrics(rows, "lang")))
    print(evaluate.write_json(a.out, retrieval.hit_metrics(rows), by_lang=by_lang, failures=evaluate.failures(rows), rows=rows))
    retriever.close()
    return 0


def train_anomaly(spark, a: argparse.Namespace) -> int:
    from torquelake.operators import runners
    from torquelake.sources import frames

    log = frames.read_variable(spark, a.log, a.rows)
    m = runners.train_recurrent(log, a.out, a.epochs, a.low_percentile, a.high_percentile, a.window_size, a.stride, a.run, batch=a.batch_size, rate=a.lr, hidden=a.hidden_size, latent=a.latent_size, seed=a.seed)
    print(json.dumps(m["test_metrics"], indent=2))
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command is None:
        parser().print_help()
        return 1
    if a.command == "version":
        print(VERSION)
        return 0
    if a.command in ("analyze-can", "train-anomaly"):
        if not os.path.exists(a.log):
            print(f"no such log: {a.log}", file=sys.stderr)
            return 2
        if a.command == "analyze-can" and a.brand and a.brand.lower() not in dims.BRAND_GLOBS:
            print(f"unknown brand: {a.brand}", file=sys.stderr)
            return 2
    from torquelake.session import build_session

    spark = build_session("cli", "local[*]")
    if a.command == "decode-vin":
        from torquelake.operators.tools import decode_vin

        text = decode_vin(spark, a.vin)
        print(text)
        return 2 if text.startswith("Error") else 0
    if a.command == "diagnose":
        return diagnose(spark, a)
    if a.command in ("analyze-can", "evaluate-retrieval", "train-anomaly"):
        return {"analyze-can": analyze_can, "evaluate-retrieval": evaluate_retrieval, "train-anomaly": train_anomaly}[a.command](spark, a)
    from torquelake.operators import protocol, report, signals

    loaded, state = signals.load_signals(spark, a.signals) if a.signals else (None, {"available": True})
    if not state["available"]:
        print(f"no signals: {state['error'] or a.signals + ' is missing'}", file=sys.stderr)
    r = report.to_dict(report.build(protocol.full_scan(spark), signals.signal_stats(loaded) if loaded else None))
    print(json.dumps(r, ensure_ascii=False, indent=2) if a.json else report.markdown(r, a.lang))
    if not a.no_save:
        print(*report.save(r, a.out))
    return 0


if __name__ == "__main__":
    sys.exit(main())
