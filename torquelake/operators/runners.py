"""Anomaly models over window statistics: fit on normal training windows, calibrate, judge the test windows; several datasets in one benchmark."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torquelake.operators import detect, forest, recurrent, windows
from torquelake.session import stored

STATS = [f"{c}_{s}" for s in ("mean", "std", "min", "max") for c in windows.FEATURES]
#: A scorer: (normal windows, windows) -> window_id, y, score.
Scorer = Callable[[DataFrame, DataFrame], DataFrame]


def isolation(normal: DataFrame, rows: DataFrame) -> DataFrame:
    return forest.score(rows, forest.fit(normal, STATS), STATS)


def reconstruction(normal: DataFrame, rows: DataFrame) -> DataFrame:
    return forest.reconstruction_scores(normal, rows, STATS)


MODELS: dict[str, tuple[Scorer, str]] = {"iforest": (isolation, "upper"), "reconstruction": (reconstruction, "bilateral")}


def prepare(frames: DataFrame, ratio: float = 0.7, size: int = 64, stride: int = 32) -> tuple[DataFrame, DataFrame]:
    """(training, test) window statistics: features over the whole log, a split in time, windows of each part."""
    n = frames.count()
    full = windows.feature_columns(windows.add_features(frames))
    parts = zip(windows.temporal_split(full, n, ratio), (int(n * ratio), n - int(n * ratio)), strict=True)
    train, test = (windows.window_stats(windows.sliding_windows(f, k, size, stride)) for f, k in parts)
    return train, test


def evaluate(train: DataFrame, test: DataFrame, scorer: Scorer, rule: str = "upper") -> DataFrame:
    """One row: thresholds from the normal training windows, confusion, precision, recall, F1 and AUC on the test windows."""
    if rule not in ("upper", "bilateral"):
        raise ValueError("rule must be upper or bilateral")
    normal = train.where("y = 0")
    own, judged = scorer(normal, normal), scorer(normal, test).persist()
    if rule == "upper":
        limit = detect.calibrate_upper(own).select(F.lit(None).cast("double").alias("low"), F.col("threshold").alias("high"))
        pred = detect.predict_upper(F.col("score"), F.col("high"))
    else:
        limit = detect.calibrate_bilateral(own)
        pred = detect.predict_bilateral(F.col("score"), F.col("low"), F.col("high"))
    p = judged.join(F.broadcast(limit)).withColumn("pred", pred)  # one row
    out = detect.confusion_metrics(p).join(detect.roc_auc(judged)).join(limit).toPandas()  # one row
    judged.unpersist()
    return train.sparkSession.createDataFrame(out.astype({c: "float64" for c in ("auc", "low", "high")}))


def benchmark(datasets: dict[str, DataFrame], models: dict[str, tuple[Scorer, str]] | None = None) -> DataFrame:
    """dataset, model, seconds and the metrics of every pair; a dataset's windows are prepared once."""
    out = None
    for name, frames in datasets.items():
        began = time.time()
        train, test = (w.persist() for w in prepare(frames))
        for model, (scorer, rule) in (models or MODELS).items():
            row = evaluate(train, test, scorer, rule).select(F.lit(name).alias("dataset"), F.lit(model).alias("model"), F.lit(round(time.time() - began, 1)).alias("seconds"), "*")
            out = row if out is None else out.unionByName(row)
        train.unpersist()
        test.unpersist()
    return out


def prepare_sequences(frames: DataFrame, ratio: float = 0.7, size: int = 64, stride: int = 32) -> tuple[DataFrame, DataFrame]:
    """(training, test) windows as sequences: features over the whole log, a split in time, windows of each part."""
    n = frames.count()
    full = windows.feature_columns(windows.add_features(frames))
    parts = zip(windows.temporal_split(full, n, ratio), (int(n * ratio), n - int(n * ratio)), strict=True)
    train, test = (recurrent.sequences(windows.sliding_windows(f, k, size, stride), windows.FEATURES) for f, k in parts)
    return train, test


def train_recurrent(frames: DataFrame, out: str, epochs: int = 10, low: float = 1.0, high: float = 99.0, size: int = 64, stride: int = 32, at: str | None = None, **options) -> dict:
    """Train the recurrent model on a log's normal windows, calibrate both limits, judge the test windows.

    Writes ``out``/model.json (weights, sizes, limits) and ``out``/metrics.json, and returns the latter. ``at`` is the folder of
    the training run's tables: given again after a stop, training goes on from its last epoch.
    """
    run = recurrent.Training(frames.sparkSession, at, **options)
    share = frames.agg(F.count("*").alias("n"), F.avg("label").alias("attacks")).first()
    train, test = (stored(w, "sequences") for w in prepare_sequences(frames, size=size, stride=stride))
    normal = train.where("y = 0")
    began = time.time()
    weights, losses = run.fit(normal, len(windows.FEATURES), epochs)
    seconds = time.time() - began
    limit = detect.calibrate_bilateral(recurrent.score(normal, weights), low=low, high=high).first()
    judged = stored(recurrent.score(test, weights), "judged")
    lo, hi = F.lit(limit.low), F.lit(limit.high)
    found = detect.confusion_metrics(judged.withColumn("pred", detect.predict_bilateral(F.col("score"), lo, hi))).first()
    auc = detect.roc_auc(judged.withColumn("score", detect.band_distance(F.col("score"), lo, hi))).first().auc
    counts = lambda w: w.agg(F.count("*").alias("n"), F.count_if(F.col("y") == 0).alias("normal"), F.avg("y").alias("attacks")).first()
    of_train, of_test = counts(train), counts(test)
    percent = lambda v: None if v is None else round(100 * v, 2)
    metrics = {
        "model": "recurrent_autoencoder_bilateral",
        "dataset": {"frames_loaded": share.n, "attack_frame_ratio_pct": percent(share.attacks), "train_windows": of_train.n, "train_normal_windows": of_train.normal, "test_windows": of_test.n, "test_attack_ratio_pct": percent(of_test.attacks)},
        "config": {
            "window_size": size, "stride": stride, "epochs": epochs, "batch_size": run.batch, "lr": run.rate, "hidden_size": run.hidden, "latent_size": run.latent,
            "low_percentile": low, "high_percentile": high, "threshold_low": round(limit.low, 6), "threshold_high": round(limit.high, 6), "seed": run.seed,
        },
        "training": {"losses": losses, "final_loss": round(losses[-1], 6), "train_time_sec": round(seconds, 1)},
        "test_metrics": {"precision": found.precision, "recall": found.recall, "f1": found.f1, "roc_auc_band_distance": auc, "confusion": {k: found[k] for k in ("tn", "fp", "fn", "tp")}},
    }
    folder = Path(out)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "metrics.json").write_text(json.dumps(metrics, indent=2))
    model = {"weights": {k: v.tolist() for k, v in weights.items()}, "features": windows.FEATURES, "window_size": size, "stride": stride, "threshold_low": limit.low, "threshold_high": limit.high}
    (folder / "model.json").write_text(json.dumps(model))
    return metrics


def load_recurrent(path: str) -> tuple[recurrent.Weights, dict]:
    """Weights and the other entries of a saved model."""
    m = json.loads(Path(path).read_text())
    return {k: np.array(v) for k, v in m.pop("weights").items()}, m
