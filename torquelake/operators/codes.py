"""Trouble codes: validation, structure, interpretation, scan summary, health score and repair plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from torquelake.functions import dims


def is_valid(code: Column) -> Column:
    return F.coalesce(F.upper(code).rlike("^[PCBU][0-9A-F]{4}$"), F.lit(False))


def structure(df: DataFrame, code: str = "code") -> DataFrame:
    """Adds system, type and (for powertrain codes) subsystem in both languages; NULL for invalid codes."""
    c = F.upper(F.col(code))
    at = lambda i: F.substring(c, i, 1)
    pick = lambda table, i: {k: v[i] for k, v in table.items()}
    out = {}
    for i, lang in enumerate(("en", "fr")):
        out[f"system_{lang}"] = dims.lookup(pick(dims.SYSTEMS, i), at(1))
        out[f"type_{lang}"] = dims.lookup(pick(dims.CODE_TYPES, i), at(2), ("Unknown", "Inconnu")[i])
        out[f"subsystem_{lang}"] = F.when(at(1) == "P", dims.lookup(pick(dims.SUBSYSTEMS, i), at(3)))
    return df.withColumns({k: F.when(is_valid(F.col(code)), v) for k, v in out.items()})


def interpret(df: DataFrame, code: str = "code") -> DataFrame:
    """Structure, and description, causes and severity of known codes (left join on a table of a dozen rows)."""
    s = structure(df.withColumn("_code", F.upper(code)), code)
    known = F.broadcast(dims.known_codes(df.sparkSession).withColumnRenamed("code", "_code"))
    out = s.join(known, "_code", "left").drop("_code")
    ok = is_valid(F.col(code))
    severity = F.when(ok, F.coalesce("known_severity", F.lit("unknown")))
    text = lambda lang, form: F.coalesce(f"known_{lang}", F.format_string(form, F.coalesce(f"subsystem_{lang}", f"system_{lang}")))
    label = lambda i, default: F.when(ok, dims.lookup({k: v[i] for k, v in dims.SEVERITIES.items()}, severity, default))
    return out.select(
        *[F.col(c) for c in s.columns if c != "_code"], ok.alias("valid"), (ok & F.col("known_en").isNotNull()).alias("in_database"),
        F.when(ok, text("en", "%s fault")).alias("description_en"), F.when(ok, text("fr", "Defaut %s")).alias("description_fr"),
        F.when(ok, F.coalesce("causes_fr", F.array(F.lit("Non repertorie - consulter la documentation technique")))).alias("likely_causes_fr"),
        severity.alias("severity_key"), label(0, "Unknown").alias("severity_en"), label(1, "Inconnu").alias("severity_fr"),
    )


def severity_rank(key: Column) -> Column:
    return dims.lookup(dims.SEVERITY_ORDER, key).cast("int")


def scan_summary(interpreted: DataFrame) -> DataFrame:
    """Counts and the gravest severity of the valid codes."""
    ok = F.col("valid")
    return interpreted.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"), F.count_if(ok & F.col("in_database")).alias("in_database"),
        F.min_by(F.when(ok, F.col("severity_key")), F.when(ok, severity_rank(F.col("severity_key")))).alias("highest_severity"),
    )


def rejected(interpreted: DataFrame, position: str) -> DataFrame:
    """code, times, first_at: the codes that the scan rejects as they were given (null ones too), a row for each with its first
    position, so that a long list is no single value. No codes, no rows."""
    bad = interpreted.where(~F.col("valid"))
    return bad.groupBy("code").agg(F.count("*").alias("times"), F.min(position).alias("first_at"))


def health_score(faults: DataFrame, by: list[str] | None = None) -> DataFrame:
    """max(0, 100 - 12 * summed weights), counts and verdict; with ``by`` for each vehicle."""
    weight = F.coalesce(dims.lookup(dims.SEVERITY_WEIGHT, F.col("severity_key")), F.lit(1))
    critical = F.count_if(F.col("severity_key") == "high")
    base = faults.groupBy(*(by or [])).agg(F.count("*").alias("n_faults"), F.greatest(F.lit(0), 100 - 12 * F.coalesce(F.sum(weight), F.lit(0))).cast("long").alias("score"), critical.alias("critical_count"), F.count_if(F.col("severity_key") == "medium").alias("medium_count"))
    verdict = F.when(F.col("n_faults") == 0, "No faults detected").when(F.col("critical_count") > 0, "Immediate action required").when(F.col("score") < 70, "Repairs recommended").otherwise("Minor faults to monitor")
    return base.withColumn("verdict_en", verdict).withColumn("action_required", (F.col("n_faults") > 0) & ((F.col("critical_count") > 0) | (F.col("score") < 70)))


def effort(description: Column, causes: Column) -> Column:
    """Effort struct of the first keyword found in description and causes."""
    text = F.lower(F.concat_ws(" ", description, F.array_join(causes, " ")))
    out = F.struct(F.lit("a evaluer").alias("effort"), F.lit(None).cast("double").alias("hours_min"), F.lit(None).cast("double").alias("hours_max"), F.lit("unknown subsystem").alias("basis"))
    for word, (level, lo, hi) in reversed(dims.EFFORT.items()):
        hint = F.struct(F.lit(level).alias("effort"), F.lit(lo).alias("hours_min"), F.lit(hi).alias("hours_max"), F.lit("indicative (flat-rate order of magnitude)").alias("basis"))
        out = F.when(text.contains(word), hint).otherwise(out)
    return out


def repair_plan(faults: DataFrame, position: str, by: list[str] | None = None) -> DataFrame:
    """Faults by severity, then input position, numbered from 1 (per ``by`` group), with effort and first checks."""
    rank = Window.partitionBy(*(by or [])).orderBy(F.coalesce(severity_rank(F.col("severity_key")), F.lit(3)), position)
    e = effort(F.col("description_fr"), F.col("likely_causes_fr"))
    out = faults.withColumn("priority", F.row_number().over(rank)).withColumn("_e", e)
    return out.select(*(by or []), "priority", "code", F.col("description_fr").alias("action_fr"), "severity_fr", F.slice("likely_causes_fr", 1, 3).alias("first_checks_fr"), "_e.effort", "_e.hours_min", "_e.hours_max", F.col("_e.basis").alias("estimate_basis"))
