"""Tool declarations, their JSON schema, parsing of model replies, run results and the diagnosis loop."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torquelake.operators import agent

#: Declared tools: name, what it does, its arguments as (name, type, meaning, required).
DECLARED = [
    ("search_repair_cases", "Search confirmed repair cases by symptom or fault code.", [("query", "string", "Symptoms or codes, in French or English.", True), ("top_k", "integer", "How many cases, 1 to 5.", False)]),
    ("decode_dtc", "Explain a diagnostic trouble code.", [("code", "string", "For example P0420.", True)]),
    ("decode_vin", "Decode a vehicle identification number.", [("vin", "string", "17 characters.", True)]),
    ("analyze_can_log", "Summarise a recorded CAN bus log.", [("path", "string", "The log file.", True)]),
]


def json_schemas(declared: list = DECLARED) -> list[dict]:
    """The declarations as function schemas."""
    return [
        {"type": "function", "function": {"name": n, "description": d, "parameters": {"type": "object", "properties": {a: {"type": t, "description": m} for a, t, m, _ in args}, "required": [a for a, _, _, must in args if must]}}}
        for n, d, args in declared
    ]


_CALL = "array<struct<id:string,function:struct<name:string,arguments:string>>>"


def parse_replies(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Adds content, call_id, tool, arguments and call_error of a reply {content, tool_calls}: the first call only.

    A call without an id gets ``call_<name>``; arguments that are no JSON object give a call_error and
    the tool is not run; a reply that is no JSON is an answer in plain words.
    """
    j = F.from_json(F.col(reply), f"content string, tool_calls {_CALL}")
    c = F.get(F.col("_j.tool_calls"), F.lit(0))
    name, raw = c["function"]["name"], F.coalesce(c["function"]["arguments"], F.lit("{}"))
    parsed = F.from_json(raw, "map<string,string>")
    broken = name.isNotNull() & (parsed.isNull() | ~F.btrim(raw).startswith("{"))
    out = replies.withColumn("_j", j)
    plain = F.col("_j").isNull() | (F.col("_j.content").isNull() & F.col("_j.tool_calls").isNull())
    return out.select(
        *replies.columns, F.when(plain, F.col(reply)).otherwise(F.col("_j.content")).alias("content"),
        F.when(name.isNotNull(), F.coalesce(F.nullif(c["id"], F.lit("")), F.concat(F.lit("call_"), name))).alias("call_id"), name.alias("tool"),
        F.when(name.isNotNull() & ~broken, F.to_json(parsed)).alias("arguments"), F.when(broken, F.concat(F.lit("The arguments of "), name, F.lit(" are not a JSON object."))).alias("call_error"),
    )


def paired(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Requests with their results by (run_id, call_id); a request nothing answers has a NULL result."""
    return requests.join(results.select("run_id", "call_id", "result"), ["run_id", "call_id"], "left")


def with_notice(trace: DataFrame) -> DataFrame:
    """The result the model reads: a repeated call is answered by a notice instead of the same text again."""
    t = trace if "repeated" in trace.columns else agent.repeated_calls(trace)
    notice = F.concat(F.lit("Notice: "), F.col("tool"), F.lit(" was already called with these arguments. Use the earlier result or answer."))
    return t.withColumn("result", F.when(F.col("repeated"), notice).otherwise(F.col("result")))


def results(runs: DataFrame, trace: DataFrame) -> DataFrame:
    """One row per run: answer, stop_reason, turns, tools_used in order of first use, cases_cited, hit_turn_limit."""
    first = trace.groupBy("run_id", "tool").agg(F.min("step").alias("step"))
    used = first.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "tool"))), lambda x: x["tool"]).alias("tools_used"))
    out = runs.join(used, "run_id", "left")
    return out.select("*", agent.cases_cited(F.col("answer")).alias("cases_cited"), (F.col("stop_reason") == "turn_limit").alias("hit_turn_limit")).withColumn("tools_used", F.coalesce("tools_used", F.array().cast("array<string>")))


def answer(spark, question: str, script: list[dict], call, max_turns: int = agent.MAX_TURNS) -> tuple[dict, list[dict]]:
    """One question through the loop with scripted replies: (result, trace). ``call(name, arguments)`` runs a tool and gives text."""
    if not question or not question.strip():
        raise ValueError("the question is empty")
    if max_turns < 1:
        raise ValueError("max_turns must be at least 1")
    replies = [json.dumps(r) for r in script] or [json.dumps({"content": ""})]
    rows = parse_replies(spark.createDataFrame([(k, r) for k, r in enumerate(replies)], "turn int, reply string")).orderBy("turn").collect()
    trace, seen = [], set()
    for turn in range(1, max_turns + 1):
        r = rows[min(turn, len(rows)) - 1]
        if r.tool is None:
            text, stop = r.content or "", "answered"
            break
        key = (r.tool, r.arguments)
        repeated = key in seen
        seen.add(key)
        if r.call_error:
            said = r.call_error
        elif repeated:
            said = f"Notice: {r.tool} was already called with these arguments. Use the earlier result or answer."
        else:
            said = call(r.tool, json.loads(r.arguments))
        trace.append({"step": turn, "call_id": r.call_id, "tool": r.tool, "arguments": r.arguments, "repeated": repeated, "result": said})
    else:
        text, stop = "No answer within the allowed turns.", "turn_limit"
    cited = spark.createDataFrame([(text,)], "t string").select(agent.cases_cited(F.col("t"))).first()[0]
    return {"answer": text, "stop_reason": stop, "turns": min(turn, max_turns), "tools_used": list(dict.fromkeys(t["tool"] for t in trace)), "cases_cited": cited, "hit_turn_limit": stop == "turn_limit"}, trace
