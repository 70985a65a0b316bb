"""Quality rules by distribution divergence (native: DataFrame functions only).

A document's character-class histogram and its common-word histogram are compared, by
Jensen-Shannon distance, with those of its language. Common words are learned: the ``COMMON`` most
frequent lower-cased words of all documents of the language. The references are corpus statistics
too: the mean histogram of every document of the language that the base rules accept. A histogram
is judged only from a minimum length on, because a short text's histogram is mostly sampling noise.

Everything about one document is computed inside its own row, so a hot source, a hot language or
a group of copies never meets in one task; the references are one small row per language. Words,
hashes and histograms leave one generator each: they are packed rows from there on, computed once,
and the next step holds none of the objects of the last.

Defined results: a null text counts as empty; an empty text has zero counts and fails the base
rules; documents without a language are one language of their own; a language none of whose
documents passes the base rules has no reference, so only the base rules decide; a text must fit a
task's memory several times over, whatever its length nothing is cut; an empty table gives an empty
result; repeated rows are judged one by one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from torquelake.llm.common import SPACES, let, materialize, text_or_empty, words

#: Common words learned for each language; languages whose lists and references are broadcast at most, and whose
#: words sieve a text's words before they are counted (the counts are the same without).
COMMON, MAX_BROADCAST_LANGS, MAX_SIEVE_LANGS = 32, 10_000, 64
NO_LANG = "und"

SYMBOLS = "#*$%&|<>"
#: Character classes counted by pattern; what none of them matches is the last class, "lower".
CLASSES = {
    "upper": r"\p{Lu}",
    "digit": r"[0-9]",
    "space": r"[\x20\x09-\x0D]",
    "symbol": r"[#*$%&|<>]",
    "stop": r"[.,;:!?]",
    "other": r"[\x22\x27-\x29\x2B\x2D\x2F\x3D\x40\x5B-\x60\x7B\x7D\x7E]",
}
CLASS_NAMES = [*CLASSES, "lower"]

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Histograms are judged from this many characters or words on.
MIN_CHARS_FOR_CLASSES = 200
MIN_WORDS_FOR_COMMON = 60
#: Jensen-Shannon distances (base 2, 0 to 1) above which a document is rejected.
MAX_CLASS_DISTANCE = 0.22
MAX_WORD_DISTANCE = 0.5


def _count(text: str, pattern: str) -> Column:
    return F.regexp_count(F.col(text), F.lit(pattern)).cast("long")


def _with(df: DataFrame, keep: list[str], **made: Column) -> DataFrame:
    """``keep`` and the ``made`` columns, out of a one-row generator: no later step repeats them."""
    return df.select(*keep, F.inline_outer(F.array(F.struct(*[v.alias(k) for k, v in made.items()]))))


def window_hashes(w: Column) -> Column:
    """A 64-bit hash of every 3-word window."""
    each = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))
    return F.when(F.size(w) < 4, F.array().cast("array<long>")).otherwise(each)


def repeat_words(h: Column) -> Column:
    """Words that lie in a window found twice or more, from the text's window hashes; without an equal pair nothing is sorted."""
    zero = F.lit(0).cast("long")

    def starts(order: Column) -> Column:
        last = F.size(order) - 1
        same = lambda i, j: F.get(order, i)["h"] == F.get(order, j)["h"]
        found = F.transform(order, lambda x, i: F.when(((i > 0) & same(i, i - 1)) | ((i < last) & same(i, i + 1)), x["p"]))
        return F.sort_array(F.filter(found, lambda p: p.isNotNull()))

    def covered(at: Column) -> Column:
        each = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
        return F.aggregate(each, zero, lambda a, x: a + x)

    order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(let(let(order, starts), covered))


def base_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the base counts of ``text``, its character classes in CLASS_NAMES' order, n_chars and its lower-cased words ``_lw``."""
    t = text_or_empty("text")
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    out = docs.select(*keep, t.alias("_t"))
    classes = {f"_c_{k}": _count("_t", p) for k, p in CLASSES.items()}
    out = _with(out, keep, _w=words(F.col("_t")), _lw=words(F.lower("_t")), _lines=lines, n_chars=F.length("_t").cast("long"), **classes)
    known = ["n_chars", "_lw", *classes]
    dup = (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")
    out = _with(out, keep + known, n_words=F.size("_w").cast("long"), n_dup_lines=dup, _h=window_hashes(F.col("_w")))
    out = _with(out, [*keep, *known, "n_words", "n_dup_lines"], n_repeat_words=repeat_words(F.col("_h")))
    rest = F.col("n_chars")
    for c in classes:
        rest = rest - F.col(c)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.select(
        *keep, "n_words", (F.col("n_chars") - F.col("_c_space")).alias("word_chars"), F.col("_c_symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "n_chars", F.array(*classes, rest).alias("classes"), "_lw",
    )


def common_words(docs: DataFrame) -> DataFrame:
    """One row per language: its COMMON most frequent words, ties in the words' order."""
    counts = docs.select("lang", F.explode(words(F.lower(text_or_empty("text")))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("c"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c"), "w"))
    top = counts.withColumn("r", place).where(F.col("r") <= COMMON)
    return top.groupBy(F.col("lang").alias("_list_lang")).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "w"))), lambda x: x["w"]).alias("_list"))


def common_counts(lw: Column, listed: Column, every: list[str] | None) -> Column:
    """How often each listed word occurs, then all others together. ``every``: the words of all lists, as a sieve."""
    found = F.filter(lw, lambda w: w.isin(every)) if every else lw
    of_list = let(found, lambda c: F.transform(listed, lambda w: (F.size(c) - F.size(F.array_remove(c, w))).cast("long")))
    others = lambda c: F.size(lw) - F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return let(of_list, lambda c: F.concat(c, F.array(others(c))))


def _by_language(df: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """``df`` with the row of its language; ``small`` is broadcast if it has few rows."""
    small = F.broadcast(small) if small.count() <= MAX_BROADCAST_LANGS else small
    return df.join(small, F.col("lang") == F.col(key), "left").drop(key)


def _shares(counts: str) -> Column:
    total = F.aggregate(F.col(counts), F.lit(0).cast("long"), lambda a, x: a + x)
    return let(total, lambda n: F.transform(F.col(counts), lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0))))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two share arrays of equal length: the root of the base-2 divergence."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    parts = F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)))


def references(shares: DataFrame) -> DataFrame:
    """One row per language: mean class and common-word shares of the documents that pass the base rules."""
    mean = lambda c, n: F.filter(F.array(*[F.avg(F.get(F.col(c), F.lit(i))) for i in range(n)]), lambda x: x.isNotNull())
    return shares.where(~F.col("base_failed")).groupBy(F.col("lang").alias("_ref_lang")).agg(
        mean("class_shares", len(CLASS_NAMES)).alias("_ref_classes"), mean("word_shares", COMMON + 1).alias("_ref_words")
    )


def divergence_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Judge every document: base counts, both distances and ``kept``.

    One pass over the texts counts the words of each language, one writes the counts (about 600 bytes
    a document) to the shared folder; references and verdicts read those only.
    """
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"))
    lists = materialize(common_words(picked), "common-words")
    stats = base_stats(_by_language(picked, lists, "_list_lang").withColumn("_list", F.coalesce("_list", F.array().cast("array<string>"))), ["doc_id", "lang", "_list"])
    few = lists.count() <= MAX_SIEVE_LANGS
    every = sorted({w for r in lists.collect() for w in r["_list"]}) if few else None  # at most MAX_SIEVE_LANGS * COMMON words
    counted = stats.withColumn("common", common_counts(F.col("_lw"), F.col("_list"), every)).drop("_lw", "_list")
    shares = materialize(counted, "quality-rules").withColumns({"class_shares": _shares("classes"), "word_shares": _shares("common")})
    out = _by_language(shares, materialize(references(shares), "quality-references"), "_ref_lang")
    out = out.withColumns(
        {
            "class_distance": F.when(F.col("n_chars") >= MIN_CHARS_FOR_CLASSES, js_distance(F.col("class_shares"), F.col("_ref_classes"))),
            "word_distance": F.when(F.col("n_words") >= MIN_WORDS_FOR_COMMON, js_distance(F.col("word_shares"), F.col("_ref_words"))),
        }
    )
    far = F.coalesce(F.col("class_distance") > MAX_CLASS_DISTANCE, F.lit(False)) | F.coalesce(F.col("word_distance") > MAX_WORD_DISTANCE, F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~far).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"
    )
