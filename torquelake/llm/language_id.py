"""Language identification by error-correcting output codes.

Each language gets a codeword; for every bit of the code one binary classifier over hashed byte
n-grams learns whether a text's language has that bit set. A text is decoded to the codeword with
the least weighted logistic loss, each bit weighted by how well its classifier separates the
training rows; a small lead over the second codeword marks the answer as ambiguous.

The classifiers are fitted on rows of every language: at most ``MAX_ROWS_PER_LANG`` of each (those
with the smallest hash of doc_id), and of more than 64 languages at most ``MAX_ROWS`` divided by
their number, but one at least; their feature matrix is all that reaches the driver. Prediction reads every whole text, batch by batch, and moves nothing.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without training
rows every text is; an empty table gives an empty result; only doc_id and text are read for a
prediction; repeated rows are predicted each.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from torquelake.llm.common import fold, materialize, tune

DIM = 4096
#: Rows to learn from, of each language and in all; the latter keeps the driver under 1 GB (16,000 x DIM numbers).
MAX_ROWS_PER_LANG, MAX_ROWS = 1000, 16_000
STEPS, RIDGE, SHARPNESS = 80, 1e-4, 1.0
#: Lead in probability under which an answer is ambiguous.
MIN_LEAD = 0.2
UNKNOWN = "und"

_OTHER = re.compile(rb"[\x00-\x60\x7b-\x7f]+")
#: Bytes of a text that are hashed at once, so that memory does not follow a text's length.
_PIECE = 1 << 20


def features(text: str) -> np.ndarray | None:
    """Root-scaled, normalised counts of hashed byte 2-grams and 3-grams of the lower-cased letters; None without a letter."""
    raw = b" " + _OTHER.sub(b" ", text.lower().encode("utf-8", "replace")).strip() + b" "
    if len(raw) < 3 or not any(map(str.isalpha, text)):
        return None
    counts = np.zeros(DIM)
    for at in range(0, len(raw), _PIECE):
        b = np.frombuffer(raw[at : at + _PIECE + 2], np.uint8).astype(np.uint32)
        if len(b) < 3:
            continue
        two = (b[:-2] << np.uint32(8)) | b[1:-1]
        three = (two << np.uint32(8)) | b[2:]
        counts += np.bincount((two * np.uint32(2654435761)) >> np.uint32(20), minlength=DIM)
        counts += np.bincount((three * np.uint32(2246822519)) >> np.uint32(20), minlength=DIM)
    v = np.sqrt(counts)
    return (v / np.linalg.norm(v)).astype(np.float32)


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """k rows of -1/+1: all distinct splits for few languages, else random balanced splits."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 6:
        rows = [(1, *bits) for bits in itertools.product((1, -1), repeat=k - 1) if -1 in bits]
        return np.array(rows).T.astype(float)
    rng = np.random.default_rng(seed)
    best, score = None, -1
    for _ in range(50):
        m = np.stack([rng.permutation([1] * (k // 2) + [-1] * (k - k // 2)) for _ in range(int(10 * np.log2(k)))], 1).astype(float)
        same = m @ m.T
        np.fill_diagonal(same, -m.shape[1])
        apart = (m.shape[1] - same.max()) / 2
        if apart > score:
            best, score = m, apart
    return best


class Model:
    """Languages, their codewords, and a linear classifier with a weight for each bit."""

    def __init__(self, langs: list[str], code: np.ndarray, w: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.langs, self.code, self.w, self.bias, self.trust = langs, code, w, bias, trust

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the languages for each row of ``x``, from the weighted loss to each codeword."""
        margin = x @ self.w + self.bias
        loss = np.stack([(self.trust * np.logaddexp(0, -margin * c)).sum(1) for c in self.code], 1)
        p = np.exp(SHARPNESS * (loss.min(1, keepdims=True) - loss))
        return p / p.sum(1, keepdims=True)


def fit(x: np.ndarray, lang: list[str]) -> Model | None:
    langs = sorted(set(lang))
    if not langs:
        return None
    code = codewords(len(langs))
    index = {v: i for i, v in enumerate(langs)}
    own = np.array([index[v] for v in lang])
    y = code[own]  # rows x bits
    share = np.bincount(own, minlength=len(langs))
    weight = (len(own) / (len(langs) * share[own]))[:, None]
    w = z = np.zeros((x.shape[1], code.shape[1]), np.float32)
    bias = zb = np.zeros(code.shape[1], np.float32)
    step, t = 16.0, 1.0
    for _ in range(STEPS):
        g = (-y * weight / (1 + np.exp(np.clip(y * (x @ z + zb), -30, 30)))).astype(np.float32) / len(own)
        w2, b2 = z - step * (x.T @ g + RIDGE * z), zb - step / 16 * g.sum(0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - bias)
        w, bias, t = w2, b2, t2
    margin = y * (x @ w + bias)
    trust = np.clip(2 * (margin > 0).mean(0) - 1, 0.05, 1)
    return Model(langs, code, w.astype(np.float32), bias, trust)


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(i, l, features(t or "")) for i, l, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)]
        rows = [r for r in rows if r[2] is not None]
        cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2].astype(np.float16).tobytes() for r in rows], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang", "x"])


def train(docs: DataFrame, usable: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Fit on the usable rows of ``docs`` with a language, up to MAX_ROWS_PER_LANG rows of each, MAX_ROWS in all."""
    tune(docs.sparkSession)
    rows = docs.where(usable).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang")).where("lang IS NOT NULL AND doc_id IS NOT NULL")
    sizes = materialize(rows.groupBy("lang").agg(F.count("*").alias("_rows")), "language-sizes")
    most = min(MAX_ROWS_PER_LANG, max(1, MAX_ROWS // max(1, sizes.count())))
    # Hashes are even: a language's `most` smallest lie under a bound from its row count, so few rows are sorted.
    hashed, top = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52)).cast("double"), float(1 << 52)
    share = most + 8 * most**0.5
    few = rows.join(F.broadcast(sizes), "lang").where(hashed * F.col("_rows") < share * top)  # one row per language
    order = F.row_number().over(Window.partitionBy("lang").orderBy(hashed, "doc_id"))
    few = few.withColumn("_n", order).where(F.col("_n") <= most).select("doc_id", "lang")
    texts = docs.where(usable).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    few = F.broadcast(few.distinct())  # at most MAX_ROWS rows, or one per language
    got = texts.join(few, "doc_id").select("doc_id", "lang", "text").mapInArrow(_with_features, "doc_id long, lang string, x binary").collect()
    got.sort(key=lambda r: (r.doc_id, r.lang))
    x = np.stack([np.frombuffer(r.x, np.float16) for r in got]).astype(np.float32) if got else np.zeros((0, DIM), np.float32)
    return fit(x, [r.lang for r in got])


def predict(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every row of ``docs``."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM x bits numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = [features(t) if t and m else None for t in b.column(1).to_pylist()]
            at = [i for i, v in enumerate(found) if v is not None]
            lang, score, unsure = [UNKNOWN] * len(found), np.zeros(len(found)), np.ones(len(found), bool)
            if at:
                p = m.decode(np.stack([found[i] for i in at]))
                top = p.argmax(1)
                lead = np.sort(p, 1)
                unsure[at] = (lead[:, -1] - (lead[:, -2] if p.shape[1] > 1 else 0)) < MIN_LEAD
                score[at] = p.max(1)
                for i, k in zip(at, top, strict=True):
                    lang[i] = m.langs[k]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def learnable() -> Column:
    """Rows that may be learned from: crc32(doc_id as text) mod 4 is not 2."""
    return fold("doc_id", 4) != 2
