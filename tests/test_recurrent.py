"""The recurrent autoencoder and its training run."""

from __future__ import annotations

import json

import numpy as np
import pytest

from torquelake.operators import recurrent, runners

FEATURES, STEPS = 3, 6


def made(n: int, seed: int = 1) -> np.ndarray:
    r = np.random.default_rng(seed)
    t = np.arange(STEPS)
    return np.stack([np.stack([np.sin(t * 0.5 + p), np.cos(t * 0.5 + p), np.full(STEPS, np.sin(p))], axis=1) for p in r.uniform(0, 6, n)])


def table(spark, x: np.ndarray):
    return spark.createDataFrame([(i, 0, v.ravel().tolist()) for i, v in enumerate(x)], "window_id long, y int, x array<double>")


def test_gradient_against_differences():
    w, x = recurrent.new_weights(FEATURES, 5, 2, seed=3), made(4)
    loss, g = recurrent.loss_and_gradient(w, x)
    assert loss == pytest.approx(recurrent.errors(w, x).sum())
    r = np.random.default_rng(0)
    for name in w:
        for _ in range(6):
            at = tuple(r.integers(0, s) for s in w[name].shape)
            kept, near = w[name][at], []
            for e in (1e-6, -1e-6):
                w[name][at] = kept + e
                near.append(recurrent.errors(w, x).sum())
            w[name][at] = kept
            assert g[name][at] == pytest.approx((near[0] - near[1]) / 2e-6, rel=1e-4, abs=1e-8), name


def test_training_stops_and_goes_on_and_does_not_depend_on_partitions(spark, tmp_path):
    x = made(60)
    options = {"batch": 20, "rate": 0.02, "hidden": 6, "latent": 3}
    whole, losses = recurrent.Training(spark, f"file://{tmp_path}/whole", **options).fit(table(spark, x).repartition(8), FEATURES, 4)
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.9 * losses[0] and len(losses) == 4
    run = lambda n: recurrent.Training(spark, f"file://{tmp_path}/cut", **options).fit(table(spark, x).coalesce(1), FEATURES, n)
    run(2)
    again, more = run(4)
    assert np.allclose(more, losses, rtol=1e-9)
    assert all(np.allclose(whole[k], again[k], rtol=1e-7, atol=1e-10) for k in whole)
    scored = {r.window_id: r.score for r in recurrent.score(table(spark, x).repartition(3), whole).collect()}
    assert np.allclose([scored[i] for i in range(60)], recurrent.errors(whole, x))


def test_no_windows(spark, tmp_path):
    with pytest.raises(ValueError):
        recurrent.Training(spark, f"file://{tmp_path}/none").fit(table(spark, made(1)).where("false"), FEATURES, 1)
    assert recurrent.score(table(spark, made(1)).where("false"), recurrent.new_weights(FEATURES, 4, 2)).count() == 0


def test_training_run_writes_model_and_metrics(spark, tmp_path):
    r = np.random.default_rng(4)
    rows = []
    for i in range(700):
        attack = 560 <= i < 640
        data = [0] * 8 if attack else [int(x) for x in r.integers(0, 40, 8)]
        rows.append((i, i * 0.001, "0000" if attack else f"03{i % 5}0", 8, data, int(attack)))
    frames = spark.createDataFrame(rows, "frame_idx long, timestamp double, can_id string, dlc int, data array<int>, label int")
    m = runners.train_recurrent(frames, str(tmp_path / "out"), epochs=3, size=16, stride=8, at=f"file://{tmp_path}/run", batch=32, rate=0.01, hidden=8, latent=4)
    assert m == json.loads((tmp_path / "out/metrics.json").read_text())
    assert m["dataset"]["train_windows"] == (490 - 16) // 8 + 1 and m["dataset"]["test_windows"] == (210 - 16) // 8 + 1
    assert m["training"]["losses"] == sorted(m["training"]["losses"], reverse=True)
    assert sum(m["test_metrics"]["confusion"].values()) == m["dataset"]["test_windows"]
    weights, rest = runners.load_recurrent(str(tmp_path / "out/model.json"))
    assert rest["threshold_low"] <= rest["threshold_high"] and weights["enc_x"].shape == (11, 32)
