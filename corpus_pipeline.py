"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of ``documents``. Between stages the result is written to Parquet and read again.

Defined results: null, empty and blank texts pass every stage but the quality classifier, which scores
them like any other; repeated rows (doc_id and text) become one in the Jaccard join; texts of any length are handled whole;
further columns pass through, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from torquelake.llm import decontamination, jaccard_join, packing, quality_classifier, substring_dedup
from torquelake.llm.common import load, materialize, scratch
from torquelake.llm.queries import vocabulary


def _boxed(docs: DataFrame) -> Column:
    """The whole row as one struct, so that none of its columns can clash with an operator's."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    rows = docs.select("doc_id", "text", _boxed(docs))
    scored = quality_classifier.rule_ensemble(rows, load(spark, sf_dir, "labels"), "quality", quality_classifier.learnable())
    return scored.where("predicted = 1").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one whose doc_id names the group."""
    found = jaccard_join.near_duplicates(docs.select("doc_id", "text"))
    named = found.where("doc_id = component_id OR n_shingles = 0 OR component_id IS NULL").select(F.col("doc_id").alias("_kept")).distinct()
    rows = docs.select("doc_id", "text", _boxed(docs)).join(named, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")
    return rows.dropDuplicates(["doc_id", "text"]).select("_row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of 35-word passages; documents left without a word go, unless they had none."""
    carried = [c for c in docs.columns if c not in ("doc_id", "text")]
    kept = substring_dedup.remove_repeated_windows(docs, keep_first=True, carry=carried).where("n_removed < n_words OR n_words = 0")
    out = {c: F.col("carry")[c] for c in carried} | {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    if "n_chars" in carried:
        out["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return kept.select(*[out[c].alias(c) for c in docs.columns])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item leaked."""
    return decontamination.drop_leaked(docs, load(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("packing", pack),
]

#: Learned scores and tokenizer ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(lambda: [docs]):  # noqa: B023 - a stage's own tables go once its result is written
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
