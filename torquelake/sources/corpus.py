"""Repair-case knowledge base: scan, validation as a violations table, flattening to bilingual documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CASE = (
    "id string, dtc_codes array<string>, brands array<string>, engine_family string, system string, symptoms_fr string, symptoms_en string, "
    "root_cause_fr string, root_cause_en string, fix_fr string, fix_en string, confirmed boolean"
)
REQUIRED = [c.split()[0] for c in CASE.split(", ")]
TEXTS = [f"{p}_{lang}" for lang in ("fr", "en") for p in ("symptoms", "root_cause", "fix")]


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a {schema_version, description, cases: [...]} file, in file order (``pos``)."""
    j = spark.read.schema(f"cases array<struct<{', '.join(c.replace(' ', ': ', 1) for c in CASE.split(', '))}>>").option("multiLine", True).json(path)
    return j.select(F.posexplode("cases").alias("pos", "c")).select("pos", "c.*")


def violations(cases: DataFrame) -> DataFrame:
    """(pos, id, rule_no, message) of every broken rule, in the order of checking. Strict callers take the first."""
    cid = F.coalesce("id", F.lit("<missing id>"))
    dup = cases.groupBy("id").agg(F.min("pos").alias("_first"))
    c = cases.join(dup, "id", "left")
    rules = [(F.col(k).isNull(), F.lit(f"missing required field '{k}'")) for k in REQUIRED]
    rules.append((F.col("pos") > F.col("_first"), F.lit("duplicate case id")))
    rules.append((F.size("dtc_codes") == 0, F.lit("dtc_codes must be a non-empty list")))
    bad = F.filter("dtc_codes", lambda x: ~F.upper(x).rlike("^[PCBU][0-9A-F]{4}$"))
    rules.append((F.size(bad) > 0, F.concat(F.lit("invalid DTC code format '"), F.get(bad, F.lit(0)), F.lit("'"))))
    rules.append((F.size("brands") == 0, F.lit("brands must be a non-empty list")))
    rules += [(F.trim(k) == "", F.lit(f"field '{k}' is empty")) for k in TEXTS]
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(i).alias("rule_no"), F.concat(cid, F.lit(": "), m).alias("message"))) for i, (test, m) in enumerate(rules)]))
    return c.select("pos", cid.alias("id"), F.explode(found).alias("v")).select("pos", "id", "v.rule_no", "v.message")


def flatten(cases: DataFrame) -> DataFrame:
    """Two documents per case, French and English."""
    codes = F.array_join(F.transform("dtc_codes", F.upper), ", ")
    # Section markers of the two languages.
    fr = F.concat(F.lit("Codes défaut: "), codes, F.lit(". Moteur: "), "engine_family", F.lit(". Symptômes: "), "symptoms_fr", F.lit(" Cause racine: "), "root_cause_fr", F.lit(" Réparation: "), "fix_fr")
    en = F.concat(F.lit("Fault codes: "), codes, F.lit(". Engine: "), "engine_family", F.lit(". Symptoms: "), "symptoms_en", F.lit(" Root cause: "), "root_cause_en", F.lit(" Fix: "), "fix_en")
    docs = F.array(F.struct(F.lit("fr").alias("lang"), fr.alias("text")), F.struct(F.lit("en").alias("lang"), en.alias("text")))
    d = cases.withColumn("_d", F.explode(docs))
    return d.select(F.concat_ws("-", "id", "_d.lang").alias("doc_id"), F.col("id").alias("case_id"), "_d.lang", "_d.text", F.transform("dtc_codes", F.upper).alias("dtc_codes"), "brands", "system", "engine_family")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def point_id(namespace: str, doc_id: Column) -> Column:
    """Name-based (SHA-1) UUID of a document id in a namespace UUID."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(doc_id, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("long").bitwiseAND(3) + 8))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a file that exists, has at least one case and breaks no rule; raises otherwise, with the first broken rule."""
    cases = read_cases(spark, path)
    if cases.isEmpty():
        raise ValueError(f"{path}: 'cases' must be a non-empty list")
    if first := violations(cases).orderBy("pos", "rule_no").head(1):
        raise ValueError(first[0].message)
    return cases


def _items(spark: SparkSession, path: str, name: str, fields: str, required: list[str]) -> DataFrame:
    """The entries of a file that is a list of them or {``name``: [...]}; raises without any, and where a required field is missing."""
    inner = ", ".join(f.replace(" ", ": ", 1) for f in fields.split(", "))
    raw = spark.read.schema(f"{fields}, {name} array<struct<{inner}>>").option("multiLine", True).json(path)
    columns = [f.split()[0] for f in fields.split(", ")]
    own = F.when(F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull(), F.array(F.struct(*columns)))
    items = raw.select(F.inline(F.coalesce(name, own)))
    if items.isEmpty():
        raise ValueError(f"{path}: no {name}")
    missing = items.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required]).first().asDict()
    if bad := [c for c, n in missing.items() if n]:
        raise ValueError(f"{path}: {name} without {', '.join(bad)}")
    return items


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """query_id, lang, text, expected_cases of a file {queries: [{id, lang, query, relevant_cases}]}."""
    q = _items(spark, path, "queries", "id string, lang string, query string, relevant_cases array<string>", ["id", "lang", "query", "relevant_cases"])
    return q.select(F.col("id").alias("query_id"), "lang", F.col("query").alias("text"), F.col("relevant_cases").alias("expected_cases"))


def load_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """run_id, type, question and expectations of a file {scenarios: [{id, type, input, expected_..., must_decline}]}; lists that are not given are empty."""
    fields = "id string, type string, input string, expected_tools array<string>, expected_cases array<string>, expected_keywords array<string>, must_decline boolean"
    s = _items(spark, path, "scenarios", fields, ["id", "type", "input"])
    lists = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("expected_tools", "expected_cases", "expected_keywords")}
    return s.withColumns(lists | {"must_decline": F.coalesce("must_decline", F.lit(False))}).withColumnsRenamed({"id": "run_id", "input": "question"})
