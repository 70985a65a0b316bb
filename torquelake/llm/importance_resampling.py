"""Importance resampling towards a target distribution, with hashed n-gram features and an exact draw.

1. Features (runs of 1 to ``MAX_RUN`` words) of all documents and of all target texts are hashed into buckets and
   counted; tasks add up their own rows, Spark adds up the tasks. A bucket's gain is the floored log ratio of
   its smoothed shares.
2. A document's weight is the floored mean of the gains of its features, looked up in the array of gains, which
   has one entry a bucket, whatever the input. A Gumbel variable from a hash of the doc_id is added, so the
   highest scores are a sample without replacement in proportion to the exponentiated weights.
3. Scores are integers. The exact histogram of the scores (bounded by their range, not by the input) gives by
   sums from the top the rank at which each score begins and the score at which the draw ends. Only documents at
   or above it are numbered, by doc_id within each score; no sort of all documents takes place.

Texts are read twice (counts, weights); what is kept in between has five numbers a document.

Defined results: a null text has no words, weight 0 and is never drawn; a text without words likewise; a null
doc_id hashes like the empty id and comes before all others; repeated rows are scored and drawn each, ties of one
doc_id go to fewer features; texts of any length are taken whole; without target texts, or without documents,
the smoothed shares still hold; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from torquelake.llm.common import materialize, tune

BUCKETS, MAX_RUN, SEED, MIN_WORDS, PERCENT = 10_000, 2, 7, 20, 25

# In UTF-8 the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ are runs of these bytes.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def feature_hashes(text: str | None, longest: int = MAX_RUN) -> tuple[np.ndarray, int]:
    """crc32 of every run of 1 to ``longest`` words (joined by one space), repeats included, and the number of words."""
    words = _WORD.findall((text or "").encode().translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint32), 0
    spaced = [b" " + w for w in words]
    runs = list(map(zlib.crc32, words))
    out = list(runs)
    for n in range(1, min(longest, len(words))):
        runs = list(map(zlib.crc32, spaced[n:], runs))  # the checksum of a run goes on from the one without its last word
        out += runs
    return np.array(out, np.uint32), len(words)


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = MAX_RUN) -> np.ndarray:
    """How many features of all ``texts`` fall in each bucket."""
    tune(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                total += np.bincount(feature_hashes(t, longest)[0] % buckets, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    counted = texts.select(F.col(text)).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():  # one row a bucket
        out[r.bucket] = r.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / corpus share)) of each bucket, one added to each count."""
    buckets = len(corpus)
    ratio = (target + 1.0) * (corpus.sum() + float(buckets)) / ((corpus + 1.0) * (target.sum() + float(buckets)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gains: np.ndarray, longest: int = MAX_RUN) -> DataFrame:
    """doc_id, n_words, n_features and the floored mean gain of each document's features."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [feature_hashes(t, longest) for t in b.column(1).to_pylist()]
            mean = [int(gains[h % len(gains)].sum()) // len(h) if len(h) else 0 for h, _ in found]
            cols = [b.column(0), *[pa.array(v, pa.int64()) for v in ([n for _, n in found], [len(h) for h, _ in found], mean)]]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 g), g the Gumbel variable of the id's hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(scored: DataFrame, eligible: Column, percent: int = PERCENT) -> DataFrame:
    """``scored`` with a column rank: 1, 2, 3... over the highest scores of the eligible rows, ``percent`` of them, null elsewhere.

    ``scored`` is read several times and should be a written table.
    """
    histogram = sorted((-r["score"], r["count"]) for r in scored.where(eligible).groupBy("score").count().collect())  # by score, not by row
    counts = np.array([n for _, n in histogram], np.int64)
    wanted = percent * int(counts.sum()) // 100
    before = np.cumsum(counts) - counts
    begins = [(-s, int(b)) for (s, _), b in zip(histogram, before, strict=True) if b < wanted]
    if not begins:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    cutoff = begins[-1][0]
    surviving = F.coalesce(eligible & (F.col("score") >= cutoff), F.lit(False))
    starts = scored.sparkSession.createDataFrame(begins, "score long, before long")
    order = Window.partitionBy("score").orderBy("doc_id", "n_features", "weight")
    drawn = scored.where(surviving).withColumn("rank", F.row_number().over(order)).join(F.broadcast(starts), "score")
    drawn = drawn.withColumn("rank", (F.col("before") + F.col("rank")).cast("long")).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return drawn.select(*scored.columns, "rank").unionByName(scored.where(~surviving).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Every document of ``docs`` with doc_id, n_features, weight, score and, if drawn, its rank."""
    gains = bucket_gains(bucket_counts(docs), bucket_counts(target))
    scored = weights(docs, gains).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = materialize(scored, "importance-scores")
    return draw(scored, F.col("n_words") >= min_words, percent).select("doc_id", "n_features", "weight", "score", "rank")
