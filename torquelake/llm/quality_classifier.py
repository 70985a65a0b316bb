"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

1. Text statistics are Spark expressions over the whole text.
2. Small gradient-boosted trees are grown on labelled rows; every path from a root to a node below
   it is a rule, a conjunction of comparisons on statistics.
3. Lasso logistic regression over rules keeps few of them (proximal gradient steps).
4. The rules that are left become one column expression; scoring all documents is one projection,
   with no shuffle and no Python.

Only the fit sees a sample: at most ``MAX_TRAIN_ROWS`` labelled rows, those with the smallest hash
of doc_id. The collected matrix is bounded by it (20,000 x 11 numbers).

Defined results: a null text counts as empty and gets a score like any other; without usable labels
every score is 0.5; with one class only, the score is that class's smoothed share; null labels are
ignored, several labels of one doc_id count as their largest; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torquelake.llm.common import fold, text_or_empty, words

MAX_TRAIN_ROWS = 20_000
N_TREES, DEPTH, RATE, MIN_LEAF = 24, 3, 0.3, 20
LASSO, STEPS = 2e-3, 400

FEATURES = ["n_words", "mean_word", "upper", "digit", "symbol", "bang", "bar", "other_marks", "dup_lines", "distinct_words", "words_per_line"]


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the FEATURES as doubles, computed over the whole text.

    They come out of a one-row inline: a later filter on what is built from them cannot be pushed below it,
    which would repeat every statistic in every rule.
    """
    out = docs.withColumn("_t", text_or_empty(text)).withColumn("_w", words(F.col("_t"))).withColumn("_lines", F.split("_t", "\n"))
    n = F.length("_t").cast("double")
    share = lambda pattern: F.coalesce(F.try_divide(F.regexp_count("_t", F.lit(pattern)).cast("double"), n), F.lit(0.0))
    n_words = F.size("_w").cast("double")
    n_lines = F.size("_lines").cast("double")
    features = {
        "n_words": n_words,
        "mean_word": F.coalesce(F.try_divide(n, n_words), F.lit(0.0)),
        "upper": share(r"\p{Lu}"),
        "digit": share("[0-9]"),
        "symbol": share("[#*$%&<>]"),
        "bang": share("!"),
        "bar": share(r"\|"),
        "other_marks": share(r"[\x22\x27-\x29\x2B\x2D\x2F\x3D\x40\x5B-\x60\x7B\x7D\x7E]"),
        "dup_lines": 1 - F.try_divide(F.size(F.array_distinct("_lines")).cast("double"), n_lines),
        "distinct_words": F.coalesce(F.try_divide(F.size(F.array_distinct("_w")).cast("double"), n_words), F.lit(1.0)),
        "words_per_line": F.coalesce(F.try_divide(n_words, n_lines), F.lit(0.0)),
    }
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.inline_outer(F.array(F.struct(*[v.alias(k) for k, v in features.items()]))))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, usable: Column, limit: int = MAX_TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """At most ``limit`` labelled rows (smallest hashes of doc_id) as a matrix of FEATURES and a 0/1 vector."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & usable)
    rows = rows.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    picked = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")  # at most ``limit`` rows
    got = statistics(picked).select("doc_id", "_y", *FEATURES).toPandas().drop_duplicates("doc_id").sort_values("doc_id")
    return got[FEATURES].to_numpy(float), got["_y"].to_numpy(float)


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, depth: int, path: tuple, rules: set, out: np.ndarray) -> None:
    """Grow one regression tree by the gain of second-order boosting; record each node's path; add leaf values to ``out``."""
    if path:
        rules.add(path)
    best = (1e-6, None)
    gs, hs = g[rows].sum(), h[rows].sum()
    if depth:
        for j, edges in enumerate(cuts):
            if not len(edges):
                continue
            at = np.searchsorted(edges, x[rows, j], side="left")  # bin b holds edges[b-1] < x <= edges[b]
            n = np.cumsum(np.bincount(at, minlength=len(edges) + 1))[:-1]
            gl, hl = (np.cumsum(np.bincount(at, v[rows], len(edges) + 1))[:-1] for v in (g, h))
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            gain[(n < MIN_LEAF) | (len(rows) - n < MIN_LEAF)] = 0
            if gain.max() > best[0]:
                best = (gain.max(), (j, float(edges[gain.argmax()])))
    if best[1] is None:
        out[rows] += -gs / (hs + 1) * RATE
        return
    j, cut = best[1]
    left = x[rows, j] <= cut
    for side, op in ((rows[left], "<="), (rows[~left], ">")):
        _grow(x, g, h, cuts, side, depth - 1, (*path, (j, op, cut)), rules, out)


def extract_rules(x: np.ndarray, y: np.ndarray) -> list[tuple]:
    """Boost small trees on logistic loss and return their distinct paths."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 49)))[:-1] for j in range(x.shape[1])]
    rules: set = set()
    f = np.zeros(len(y))
    for _ in range(N_TREES):
        p = 1 / (1 + np.exp(-f))
        _grow(x, p - y, p * (1 - p), cuts, np.arange(len(y)), DEPTH, (), rules, f)
    return sorted(rules)


def apply_rule(rule: tuple, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, op, cut in rule:
        out &= x[:, j] <= cut if op == "<=" else x[:, j] > cut
    return out


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[tuple, float]]]:
    """The intercept and the rules with a non-zero weight: lasso logistic regression by FISTA."""
    if not len(y):
        return 0.0, []
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    rules = extract_rules(x, y) if 0 < y.sum() < len(y) else []
    if not rules:
        return bias, []
    r = np.stack([apply_rule(k, x) for k in rules], 1).astype(float)
    a = np.hstack([r, np.ones((len(y), 1))])
    step = 4 * len(y) / (np.linalg.norm(a, 2) ** 2)
    w = z = np.append(np.zeros(len(rules)), bias)
    t = 1.0
    for _ in range(STEPS):
        v = z - step * (a.T @ (1 / (1 + np.exp(-(a @ z))) - y)) / len(y)
        v[:-1] = np.sign(v[:-1]) * np.maximum(np.abs(v[:-1]) - step * LASSO, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, z, t = v, v + (t - 1) / t2 * (v - w), t2
    return float(w[-1]), [(k, float(v)) for k, v in zip(rules, w[:-1], strict=True) if abs(v) > 1e-6]


def compile_score(bias: float, rules: list[tuple[tuple, float]]) -> Column:
    """The model as one column expression over the FEATURES."""
    total = F.lit(bias)
    for rule, weight in rules:
        test = F.lit(True)
        for j, op, cut in rule:
            c = F.col(FEATURES[j])
            test = test & ((c <= F.lit(cut)) if op == "<=" else (c > F.lit(cut)))
        total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def rule_ensemble(docs: DataFrame, labels: DataFrame, label: str = "quality", usable: Column | None = None) -> DataFrame:
    """Fit on the usable labels of ``docs`` and score all of ``docs``: its columns plus score and predicted."""
    x, y = training_rows(docs, labels, label, F.lit(True) if usable is None else usable)
    bias, rules = fit(x, y)
    names = docs.columns
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("text").alias("text"))
    scored = statistics(boxed).withColumn("score", compile_score(bias, rules))
    own = [F.col("_row")[c].alias(c) for c in names if c not in ("score", "predicted")]
    return scored.select(*own, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def learnable() -> Column:
    """Rows whose labels may be learned: crc32(doc_id as text) mod 3 is not 1."""
    return fold("doc_id", 3) != 1
