"""The diagnostic report: one nested row, and its JSON, Markdown and console forms."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torquelake.operators import codes, signals, vin


def build(faults: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """One row: vehicle, health, faults, correlation, repair plan. ``faults`` are one vehicle's, as a full scan gives them."""
    health = codes.health_score(faults).select(F.struct("*").alias("health"))
    plan = codes.repair_plan(faults, "pos").agg(F.array_sort(F.collect_list(F.struct("*"))).alias("repair_plan"))
    each = faults.agg(F.array_sort(F.collect_list(F.struct("pos", "code", "status", "status_bits", "severity_key", "description_en", "description_fr", signals.context_notes(F.col("freeze_frame")).alias("context_notes_fr")))).alias("faults"))
    car = vin.decode(faults.select("vin").limit(1)).select(F.struct("*").alias("vehicle"))
    out = car.join(health).join(each).join(plan)
    if stats is not None:
        c = signals.freeze_correlation(faults, stats).agg(F.array_sort(F.collect_list(F.struct("*"))).alias("correlation"))
        out = out.join(c)
    return out.withColumn("generated_at", F.current_timestamp())


def to_dict(report: DataFrame) -> dict:
    return json.loads(report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0])


def markdown(r: dict, lang: str = "en") -> str:
    """The report in Markdown; ``lang`` (en or fr) picks the language of verdict and fault descriptions."""
    lines = ["# Diagnostic report", "", f"Vehicle: {r['vehicle']['manufacturer']} {r['vehicle']['year']} ({r['vehicle']['vin']})", f"Health score: {r['health']['score']}/100, {r['health'].get('verdict_' + lang) or r['health']['verdict_en']}", "", "## Repair plan", "", "| # | Code | Action | Effort | Hours |", "|-|-|-|-|-|"]
    lines += [f"| {p['priority']} | {p['code']} | {p['action_fr']} | {p['effort']} | {p['hours_min']} to {p['hours_max']} |" for p in r["repair_plan"]]
    lines += ["", "## Faults", ""] + [f"- {f['code']}: {f['description_' + lang] or f['description_en']} ({', '.join(f['status_bits'])}); {'; '.join(f['context_notes_fr'])}" for f in r["faults"]]
    lines += [f"- {c['code']} {c['freeze_condition']} = {c['freeze_value']}: {c['interpretation']}, z = {c['z_score']}" for c in r.get("correlation", [])]
    return "\n".join(lines) + "\n"


def save(r: dict, folder: str) -> tuple[Path, Path]:
    """Write the report as JSON (UTF-8, indented) and Markdown under time-stamped names; both are small, so the driver writes them."""
    stem = Path(folder) / f"report_{datetime.now(timezone.utc):%Y%m%d_%H%M%S}"
    stem.parent.mkdir(parents=True, exist_ok=True)
    a, b = stem.with_suffix(".json"), stem.with_suffix(".md")
    a.write_text(json.dumps(r, ensure_ascii=False, indent=2), encoding="utf-8")
    b.write_text(markdown(r), encoding="utf-8")
    return a, b
