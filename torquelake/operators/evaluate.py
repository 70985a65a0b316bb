"""Evaluation of retrieval and of agent runs: per-query rows, failures, disagreement, summaries, a retry of degraded runs, JSON files."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torquelake.operators import quantiles


def per_query(hits: DataFrame, relevant: DataFrame, systems: list[str], top_k: int = 5) -> DataFrame:
    """system, query, first_rank of every query for each of ``systems``, NULL where no hit is relevant.

    ``hits``: system, query, item, rank; ``relevant``: query, item. A system that returns nothing for a
    query, or nothing at all, misses it.
    """
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    found = hits.where(F.col("rank") <= top_k).join(relevant.distinct(), ["query", "item"]).groupBy("system", "query").agg(F.min("rank").alias("first_rank"))
    asked = relevant.select("query").distinct().withColumn("system", F.explode(F.array(*[F.lit(s) for s in systems])))
    return asked.join(found, ["system", "query"], "left").select("system", "query", "first_rank")


def failures(rows: DataFrame) -> DataFrame:
    """Queries without any relevant hit."""
    return rows.where("first_rank IS NULL").select("system", "query")


def divergence(rows: DataFrame) -> DataFrame:
    """Queries on whose first hit the systems disagree, with the systems that have it right."""
    right = F.coalesce(F.col("first_rank") == 1, F.lit(False))
    per = rows.groupBy("query").agg(F.count_distinct(right).alias("kinds"), F.array_sort(F.collect_list(F.when(right, F.col("system")))).alias("right"))
    return per.where("kinds > 1").select("query", "right")


def agent_summary(runs: DataFrame, order: str = "run_id") -> DataFrame:
    """One row over scored runs. Degraded runs, which never reached the model, are counted and left out of all else.

    Shares are NULL where there is nothing to score; latencies leave out the first scored run in ``order``, which
    loads the model. A column that ``runs`` lacks (turns, stop_reason) gives NULL.
    """
    have = set(runs.columns)
    of = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    degraded = F.coalesce(of("degraded", "boolean"), F.lit(False))
    ids = runs.where(degraded).agg(F.count("*").alias("degraded"), F.array_sort(F.collect_list(F.col(order).cast("string"))).alias("degraded_ids"))
    scored = runs.where(~degraded)
    first = scored.agg(F.min(F.struct(order, "latency_ms")).alias("c")).select(F.col(f"c.{order}").alias("_first"), F.col("c.latency_ms").alias("cold_ms"))
    rows = scored.join(F.broadcast(first))  # one row
    warm = F.when(F.col(order) != F.col("_first"), F.col("latency_ms"))
    trap, lexical, structural = (F.coalesce(F.col(c), F.lit(False)) for c in ("must_decline", "declined_lexically", "declined_structurally"))
    share = lambda c: F.bround(F.avg(c.cast("int")), 4)
    ratio = lambda a, b: F.bround(F.try_divide(F.sum(a).cast("double"), F.sum(b)), 4)
    missed, found = F.size("cases_expected_missed"), F.size("cases_expected_found")
    out = rows.agg(
        F.count("*").alias("n"), share(F.col("tools_exact")).alias("tools_exact"), share(F.col("tools_covered")).alias("tools_covered"),
        share(F.size("cases_hallucinated") == 0).alias("citations_grounded"), F.coalesce(F.sum(F.size("cases_hallucinated")), F.lit(0)).alias("hallucinated"), ratio(found, found + missed).alias("case_recall"),
        ratio(F.size("keywords_hit"), F.size("expected_keywords")).alias("keyword_coverage"), F.count_if(trap).alias("traps"),
        F.count_if(trap & structural).alias("declined_structurally"), F.count_if(trap & lexical).alias("declined_lexically"), share(F.when(trap, structural)).alias("decline_rate"),
        F.count_if(trap & lexical & ~structural).alias("lexical_only"), F.count_if(trap & structural & ~lexical).alias("structural_only"), F.count_if(~trap).alias("normal_runs"),
        F.count_if(of("stop_reason", "string") == "turn_limit").alias("turn_limit"), F.bround(F.avg(of("turns", "int")), 2).alias("mean_turns"),
        F.max("cold_ms").alias("cold_ms"), F.bround(F.avg(warm), 1).alias("warm_mean_ms"), F.max(warm).alias("warm_max_ms"),
    )
    return out.join(ids).join(quantiles.exact(rows.select(warm.alias("warm")), "warm", {"warm_median_ms": 0.5})).withColumn("warm_median_ms", F.bround("warm_median_ms", 1))  # one row each


def repeated_total(trace: DataFrame) -> DataFrame:
    return trace.agg(F.count_if("repeated").alias("repeated_calls"))


def retry_degraded(runs: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Ask again, once, for the runs whose answer is degraded; ``ask`` gives rows like ``runs``."""
    again = ask(runs.where("degraded").drop("degraded"))
    return runs.where("NOT degraded").drop("degraded").unionByName(again.select([c for c in runs.columns if c != "degraded"]))


def latency_by(df: DataFrame, column: str, by: str) -> DataFrame:
    """n, mean and p95 of each group, p95 the value at index round-half-even(0.95 (n - 1)) in order."""
    sums = df.where(F.col(column).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.avg(column).alias("mean"))
    ranked = quantiles.at_ranks(df, column, sums.select(by, F.bround(0.95 * (F.col("n") - 1)).cast("long").alias("rank")), [by])
    return sums.join(ranked.select(by, F.col("value").alias("p95")), sums[by].eqNullSafe(ranked[by])).select(sums[by], "n", "mean", "p95")


def write_json(path: str, summary: DataFrame, **tables: DataFrame) -> Path:
    """A benchmark file: the one-row summary, and tables of a stated query set."""
    out = {"summary": json.loads(summary.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0])}
    out |= {k: [json.loads(r) for (r,) in t.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()] for k, t in tables.items()}
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(json.dumps(out, ensure_ascii=False, indent=2), encoding="utf-8")
    return p


def markdown_table(rows: DataFrame) -> str:
    """A small result as a Markdown table."""
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.collect()]) + "\n"
