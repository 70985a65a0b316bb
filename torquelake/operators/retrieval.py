"""Retrieval: tokens, BM25, dense cosine, reciprocal rank fusion and ranking metrics."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from torquelake.operators import blocks, text_blocks
from torquelake.session import stored

# Fixed values.
K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60
#: Queries' terms that are broadcast at most.
MAX_BROADCAST_TERMS = 1_000_000


def _decomposed() -> tuple[str, str]:
    """Letters of the Latin blocks whose compatibility decomposition starts with one of a-z or 0-9 alone, and that letter; then combining marks, which go."""
    pairs = [(chr(c), "".join(x for x in unicodedata.normalize("NFKD", chr(c)).lower() if not unicodedata.combining(x))) for c in [*range(0xAA, 0x250), *range(0x1E00, 0x1F00), *range(0xFF10, 0xFF5B)]]
    one = [(a, b) for a, b in pairs if len(b) == 1 and b.isascii() and b.isalnum()]
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(a for a, _ in one) + marks, "".join(b for _, b in one)


ACCENTS, PLAIN = _decomposed()
#: Ligatures that decompose to several letters.
LIGATURES = {chr(c): unicodedata.normalize("NFKD", chr(c)) for c in [*range(0xFB00, 0xFB07), 0x132, 0x133]}


_LIGATURE = f"[{''.join(LIGATURES)}]"


def tokens(text: Column) -> Column:
    """Lower-cased, unaccented runs of [a-z0-9]. Texts of ASCII only need no look at their letters, those without ligatures no replacing."""
    t = F.coalesce(text, F.lit(""))
    spread = t
    for a, b in LIGATURES.items():
        spread = F.replace(spread, F.lit(a), F.lit(b))
    plain = lambda x: F.translate(F.lower(x), ACCENTS, PLAIN)
    t = F.when(~t.rlike(r"[^\x00-\x7f]"), F.lower(t)).when(~t.rlike(_LIGATURE), plain(t)).otherwise(plain(spread))
    return F.regexp_extract_all(t, F.lit("[a-z0-9]+"), F.lit(0))


def overfetch(top_k: int) -> int:
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    return 2 * top_k + 4


def bm25_index(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(postings: term, doc, tf, dl, idf, avgdl; lengths: doc, dl). Negative idf is floored at a share of the mean idf."""
    t = docs.select(F.col(doc).alias("doc"), tokens(F.col(text)).alias("w"))
    lengths = t.select("doc", F.size("w").cast("long").alias("dl"))
    tf = t.select("doc", F.size("w").cast("long").alias("dl"), F.explode("w").alias("term")).groupBy("term", "doc", "dl").agg(F.count("*").alias("tf"))
    corpus = lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(corpus))
    raw = df.withColumn("idf0", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = raw.agg((EPSILON * F.avg("idf0")).alias("floor"))
    idf = raw.join(F.broadcast(floor)).select("term", "avgdl", F.when(F.col("idf0") < 0, F.col("floor")).otherwise(F.col("idf0")).alias("idf"))
    return tf.join(idf, "term"), lengths


def bm25_scores(postings: DataFrame, queries: DataFrame, query: str = "query_id", text: str = "text") -> DataFrame:
    """query, doc, score of every document with a query term; each occurrence of a term in the query counts."""
    q = queries.select(F.col(query).alias("query"), F.explode(tokens(F.col(text))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qn"))
    part = F.col("qn") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    q = F.broadcast(q) if q.count() <= MAX_BROADCAST_TERMS else q
    return postings.join(q, "term").groupBy("query", "doc").agg(F.sum(part).alias("score"))


def bm25_search(docs: DataFrame, queries: DataFrame, doc: str = "doc_id", query: str = "query_id", text: str = "text") -> DataFrame:
    """What ``bm25_scores`` over ``bm25_index`` gives, without postings of terms that no query has.

    One pass over the texts counts in how many documents each term is, and with them documents and lengths (the row of the
    null term); only these counts are shuffled. A second one scores the documents that hold a query term.
    """
    t = docs.select(F.col(doc).alias("doc"), tokens(F.col(text)).alias("w"))
    marked = t.select(F.size("w").cast("long").alias("dl"), F.explode(F.concat(F.array_distinct("w"), F.array(F.lit(None).cast("string")))).alias("term"))
    counts = stored(marked.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("dl")), "document-counts")
    whole = counts.where("term IS NULL").select("df", "dl").first()
    if whole is None:
        n, avgdl = 0, 1.0
    else:
        n, avgdl = whole["df"], (whole["dl"] or 0) / whole["df"]
    idf0 = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    raw = counts.where("term IS NOT NULL").select("term", idf0.alias("idf0"))
    floor = EPSILON * (raw.agg(F.avg("idf0")).first()[0] or 0.0)
    asked = queries.select(F.col(query).alias("query"), F.explode(tokens(F.col(text))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qn"))
    weighed = stored(asked.join(raw, "term").select("query", "term", (F.col("qn") * F.when(F.col("idf0") < 0, floor).otherwise(F.col("idf0"))).alias("weight")), "query-terms")
    by_term = weighed.groupBy("term").agg(F.collect_list(F.struct("query", "weight")).alias("asking"))
    by_term = F.broadcast(by_term) if weighed.count() <= MAX_BROADCAST_TERMS else by_term
    tf = t.select("doc", F.size("w").cast("long").alias("dl"), F.explode("w").alias("term")).join(by_term.select("term"), "term").groupBy("term", "doc", "dl").agg(F.count("*").alias("tf"))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))
    hits = tf.join(by_term, "term").select("doc", part.alias("part"), F.inline("asking"))
    return hits.groupBy("query", "doc").agg(F.sum(F.col("weight") * F.col("part")).alias("score"))


def _words(rows: DataFrame, key: str, text: str) -> DataFrame:
    return rows.select(F.col(key).alias("id"), tokens(F.col(text)).alias("w"))


def bm25_topk(docs: DataFrame, queries: DataFrame, top_k: int, doc: str = "doc_id", query: str = "query_id", text: str = "text", every: bool = False) -> DataFrame:
    """query, doc, score, rank: what ``rank`` of ``bm25_search`` gives (``every``: what ``all_topk`` of it gives), by blocks of texts."""
    return rank(text_blocks.best(_words(docs, doc, text), _words(queries, query, text), top_k, every), top_k=top_k)


def bm25_totals(docs: DataFrame, queries: DataFrame, doc: str = "doc_id", query: str = "query_id", text: str = "text") -> DataFrame:
    """query, n_docs, best, total of what ``bm25_search`` gives, by blocks of texts."""
    return text_blocks.totals(_words(docs, doc, text), _words(queries, query, text))


def all_topk(scores: DataFrame, queries: DataFrame, docs: DataFrame, top_k: int) -> DataFrame:
    """The best ``top_k`` of all documents for every query (a stated set, column ``query``), ranked; those without a query term have score 0.

    Documents without a score are looked at only for queries with too few that have one.
    """
    best = stored(rank(scores, top_k=top_k).drop("rank"), "best")
    enough = best.where("score >= 0").groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= top_k)
    poor = queries.select("query").distinct().join(enough, "query", "left_anti")
    if poor.isEmpty():
        return rank(best, top_k=top_k)
    rest = docs.select("doc").join(poor).join(scores.select("query", "doc"), ["query", "doc"], "left_anti").withColumn("score", F.lit(0.0))
    return rank(best.unionByName(rest.select(best.columns)), top_k=top_k)


def rank(scores: DataFrame, by: str = "query", item: str = "doc", top_k: int | None = None, places: int = 9) -> DataFrame:
    """1-based rank by score, then item; ``top_k`` keeps the best (Spark limits each group before the shuffle)."""
    w = Window.partitionBy(by).orderBy(F.desc(F.round("score", places)), item)
    out = scores.withColumn("rank", F.row_number().over(w))
    return out if top_k is None else out.where(F.col("rank") <= top_k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dense_scores(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Every query (query, q) against every point (doc, embedding): a stated, broadcast query set, not pairs of the corpus."""
    return corpus.join(F.broadcast(queries)).select("query", "doc", *[c for c in corpus.columns if c not in ("doc", "embedding")], cosine(F.col("q"), F.col("embedding")).alias("score"))


def dense_topk(queries: DataFrame, corpus: DataFrame, top_k: int) -> DataFrame:
    """query, doc, payload, score, rank: what ``rank`` of ``dense_scores`` gives, by blocks, so that no row is made for each pair."""
    return rank(blocks.dense_best(queries, corpus, top_k), top_k=top_k)


def best_per_case(ranked: DataFrame, case: str, top_k: int) -> DataFrame:
    """Best-scoring document of each case among the hits, ranked again."""
    w = Window.partitionBy("query", case).orderBy("rank")
    one = ranked.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "rank")
    return rank(one, item=case, top_k=top_k)


def rrf(dense: DataFrame, lexical: DataFrame, case: str, top_k: int) -> DataFrame:
    """Fused score of two rankings by union and one aggregation; ties by dense, then lexical rank."""
    both = dense.select("query", case, F.col("rank").alias("dr"), F.lit(None).cast("int").alias("lr")).unionByName(lexical.select("query", case, F.lit(None).cast("int").alias("dr"), F.col("rank").alias("lr")))
    s = both.groupBy("query", case).agg(F.max("dr").alias("dr"), F.max("lr").alias("lr"))
    score = F.coalesce(1 / (RRF_K + F.col("dr")), F.lit(0.0)) + F.coalesce(1 / (RRF_K + F.col("lr")), F.lit(0.0))
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 12)), F.col("dr").asc_nulls_last(), F.col("lr").asc_nulls_last())
    return s.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def hit_metrics(first_ranks: DataFrame, group: str | None = None) -> DataFrame:
    """Hit@1, 3, 5 and MRR over queries with the rank of their first relevant hit (NULL: none); with ``group`` also by it, in one pass of grouping sets."""
    hit = lambda k: F.avg(F.coalesce((F.col("first_rank") <= k).cast("double"), F.lit(0.0))).alias(f"hit_{k}")
    aggs = [F.count("*").alias("n"), hit(1), hit(3), hit(5), F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))).alias("mrr")]
    return first_ranks.agg(*aggs) if group is None else first_ranks.rollup(group).agg(*aggs)
