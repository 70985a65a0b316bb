"""Agent traces: repeated calls, citations, grounding, declines, scenario scores and a turn-synchronous loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from torquelake.functions import dims

MAX_TURNS = 5


def repeated_calls(trace: DataFrame) -> DataFrame:
    """Adds ``repeated``: the same tool with the same arguments was called earlier in the run."""
    w = Window.partitionBy("run_id", "tool", "arguments").orderBy("step")
    return trace.withColumn("repeated", F.row_number().over(w) > 1)


def cases_in(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)case-[0-9]+"), F.lit(0)), F.lower)))


def cases_cited(text: Column) -> Column:
    """Distinct words that start with "case-" once surrounding punctuation is gone, in order."""
    w = F.transform(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: F.btrim(x, F.lit("(),.:;[]")))
    return F.array_distinct(F.filter(w, lambda x: x.startswith("case-")))


def flat(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def declines(text: Column) -> Column:
    f = flat(text)
    out = F.lit(False)
    for m in dims.DECLINE_MARKERS:
        out = out | f.contains(m)
    return out


def keywords_hit(answer: Column, keywords: Column) -> Column:
    f = flat(answer)
    return F.filter(F.transform(keywords, F.lower), lambda k: F.contains(f, k))


def score_scenarios(runs: DataFrame) -> DataFrame:
    """One row of evidence per run (answer, tools_used, cases_grounded) against its scenario's expectations."""
    used, expected = F.array_distinct("tools_used"), F.array_distinct("expected_tools")
    claimed = cases_in(F.col("answer"))
    grounded = F.array_distinct(F.transform("cases_grounded", F.lower))
    want = F.transform("expected_cases", F.lower)
    structural = (F.size(used) == 0) & (F.size(claimed) == 0)
    return runs.select(
        "*", (F.array_sort(used) == F.array_sort(expected)).alias("tools_exact"), (F.size(F.array_except(expected, used)) == 0).alias("tools_covered"),
        F.array_sort(F.array_except(used, expected)).alias("extra_tools"), F.array_sort(F.array_except(claimed, grounded)).alias("cases_hallucinated"),
        F.array_sort(F.array_intersect(want, grounded)).alias("cases_expected_found"), F.array_sort(F.array_except(want, grounded)).alias("cases_expected_missed"),
        keywords_hit(F.col("answer"), F.col("expected_keywords")).alias("keywords_hit"), declines(F.col("answer")).alias("declined_lexically"), structural.alias("declined_structurally"),
        F.when(F.col("must_decline"), structural).alias("decline_ok"), F.coalesce(F.col("answer").startswith(dims.DEGRADED_PREFIX), F.lit(False)).alias("degraded"),
    )


def run_turns(runs: DataFrame, complete: Callable[[DataFrame], DataFrame], tools: Callable[[DataFrame], DataFrame], max_turns: int = MAX_TURNS) -> tuple[DataFrame, DataFrame]:
    """All open runs advance by one turn at a time: one completion and one tool step per turn, as DataFrames.

    ``complete`` adds (content, tool, arguments) to (run_id, turn, history); ``tools`` adds ``result``.
    Returns (finished runs: run_id, answer, stop_reason, turns) and the trace.
    """
    open_, done, trace = runs.select("run_id", F.col("input").alias("history")), None, None
    for turn in range(1, max_turns + 1):
        step = complete(open_.withColumn("turn", F.lit(turn))).persist()
        over = step.where("tool IS NULL").select("run_id", F.col("content").alias("answer"), F.lit("answered").alias("stop_reason"), F.lit(turn).alias("turns"))
        called = tools(step.where("tool IS NOT NULL")).select("run_id", F.lit(turn).alias("step"), "tool", "arguments", "result", "history")
        done = over if done is None else done.unionByName(over)
        trace = called.drop("history") if trace is None else trace.unionByName(called.drop("history"))
        open_ = called.select("run_id", F.concat_ws("\n", "history", "result").alias("history"))
        if step.where("tool IS NOT NULL").isEmpty():
            break
    late = open_.select("run_id", F.lit("Turn limit reached.").alias("answer"), F.lit("turn_limit").alias("stop_reason"), F.lit(max_turns).alias("turns"))
    return done.unionByName(late), repeated_calls(trace)


def scripted(script: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A completion step that answers from (run_id, turn, content, tool, arguments); the last line repeats. Scripts grow with the runs, so they are never broadcast."""
    last = script.groupBy("run_id").agg(F.max("turn").alias("_last")).hint("merge")

    def complete(df: DataFrame) -> DataFrame:
        d = df.join(last, "run_id").withColumn("_at", F.least("turn", "_last"))
        s = script.withColumnRenamed("turn", "_at").hint("merge")
        return d.join(s, ["run_id", "_at"]).drop("_at", "_last")

    return complete
