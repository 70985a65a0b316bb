"""Isolation forest and principal-component reconstruction over window statistics."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 256


def _c(n: float) -> float:
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int, nodes: list) -> int:
    at = len(nodes)
    nodes.append(None)
    spread = x.max(0) - x.min(0) if len(x) else np.zeros(1)
    if depth >= limit or len(x) < 2 or not spread.any():
        nodes[at] = (-1, 0.0, 0, 0, depth + _c(len(x)), len(x))
        return at
    f = int(rng.choice(np.flatnonzero(spread)))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    left = x[:, f] < cut
    nodes[at] = (f, cut, _grow(x[left], rng, depth + 1, limit, nodes), _grow(x[~left], rng, depth + 1, limit, nodes), 0.0, len(x))
    return at


def fit(windows: DataFrame, columns: list[str], trees: int = 200, seed: int = 42) -> list[np.ndarray]:
    """Trees over samples of at most 256 rows each, drawn from a bounded pool of rows (the smallest hashes of window_id)."""
    pool = np.array([list(r) for r in windows.orderBy(F.xxhash64("window_id"), "window_id").limit(trees * SAMPLE // 4).select(*columns).collect()], float)
    if not len(pool):
        raise ValueError("no windows to learn from")
    rng, out = np.random.default_rng(seed), []
    for _ in range(trees):
        nodes: list = []
        rows = pool[rng.choice(len(pool), min(SAMPLE, len(pool)), replace=False)]
        _grow(rows, rng, 0, int(np.ceil(np.log2(max(2, len(rows))))), nodes)
        out.append(np.array(nodes))
    return out


def path_length(tree: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), int)
    while (tree[at, 0] >= 0).any():
        f = tree[at, 0].astype(int)
        inner = f >= 0
        left = x[np.arange(len(x)), np.maximum(f, 0)] < tree[at, 1]
        at = np.where(inner, np.where(left, tree[at, 2], tree[at, 3]).astype(int), at)
    return tree[at, 4]


def save(forest: list[np.ndarray], columns: list[str], thresholds: dict, path: str) -> None:
    """The model as one JSON file: trees, columns and thresholds."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps({"columns": columns, "thresholds": thresholds, "trees": [t.tolist() for t in forest]}))


def load(path: str) -> tuple[list[np.ndarray], list[str], dict]:
    m = json.loads(Path(path).read_text())
    return [np.array(t) for t in m["trees"]], m["columns"], m["thresholds"]


def rows_of(tree: np.ndarray) -> int:
    """Rows a tree was grown from: it records them in its root."""
    return int(tree[0, 5])


def score(windows: DataFrame, forest: list[np.ndarray], columns: list[str]) -> DataFrame:
    """window_id, y, score = 2^(-mean path / c(rows of a tree)): higher is more anomalous. Trees are a few hundred rows each, broadcast."""
    shared = windows.sparkSession.sparkContext.broadcast(forest)
    norm = max(_c(rows_of(forest[0])), 1e-12)

    def run(batches):
        for pdf in batches:
            x = pdf[columns].to_numpy(float)
            depth = np.mean([path_length(t, x) for t in shared.value], axis=0) if len(x) else np.zeros(0)
            yield pdf[["window_id", "y"]].assign(score=np.power(2.0, -depth / norm))

    return windows.select("window_id", "y", *columns).mapInPandas(run, "window_id long, y int, score double")


def reconstruction_scores(normal: DataFrame, windows: DataFrame, columns: list[str], k: int = 16) -> DataFrame:
    """Mean squared error of reconstructing standardised statistics from the first k components of normal windows.

    Moments are aggregated in Spark (a matrix of len(columns)^2 numbers); scoring is a column expression.
    """
    k = min(k, len(columns) - 1)
    d = len(columns)

    def moments(batches):
        total = np.zeros(1 + d + d * d)
        for pdf in batches:
            x = pdf[columns].to_numpy(float)
            total += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
        yield pd.DataFrame({"m": [total.tolist()]})

    sums = normal.select(*columns).mapInPandas(moments, "m array<double>").select(F.posexplode("m")).groupBy("pos").agg(F.sum("col").alias("v"))
    m = np.zeros(1 + d + d * d)
    for r in sums.collect():  # 1 + d + d * d numbers
        m[r.pos] = r.v
    n = max(m[0], 1.0)
    mean = m[1 : d + 1] / n
    cov = m[d + 1 :].reshape(d, d) / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    _, v = np.linalg.eigh(cov / np.outer(sd, sd))
    rest = v[:, : len(columns) - k]  # the components that are left out carry the error
    z = F.array(*[(F.col(c) - float(mean[i])) / float(sd[i]) for i, c in enumerate(columns)])
    matrix = F.from_json(F.lit(json.dumps(rest.T.tolist())), "array<array<double>>")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    scored = windows.select("window_id", "y", z.alias("_z")).join(F.broadcast(windows.sparkSession.range(1).select(matrix.alias("_m"))))
    error = total(F.transform("_m", lambda row: F.pow(total(F.zip_with(row, F.col("_z"), lambda p, q: p * q)), 2)))
    return scored.select("window_id", "y", (error / len(columns)).alias("score"))
