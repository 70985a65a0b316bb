"""Recurrent autoencoder of frame windows, trained by Spark jobs.

An encoder LSTM reads a window; its last state is squeezed to a latent vector; a decoder LSTM that is given this vector
at every step rebuilds the window. The score of a window is the mean squared error over steps and features.

Training windows are written once, split into batches by a hash, one folder a batch. A step is a Spark job over one
batch: every task sums the gradient and the loss of its windows in numpy (back-propagation through time), a few tasks add
these up, and the driver, which holds the weights only, takes an Adam step. Batches are at most ``MAX_BATCHES``, so steps do
not grow with the data. After each epoch weights and moments are a table; a run that was stopped goes on from the last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from torquelake.session import scratch_path

#: Batches of an epoch at most, windows a task holds at once, tasks that add up gradients.
MAX_BATCHES, CHUNK, ADDERS = 64, 256, 8

Weights = dict[str, np.ndarray]


def new_weights(features: int, hidden: int = 64, latent: int = 16, seed: int = 42) -> Weights:
    """Uniform in +-1/sqrt(hidden), or of the layer's input; forget gates begin open."""
    r = np.random.default_rng(seed)
    shapes = {
        "enc_x": (features, 4 * hidden), "enc_h": (hidden, 4 * hidden), "enc_b": (4 * hidden,), "to_w": (hidden, latent), "to_b": (latent,), "from_w": (latent, hidden), "from_b": (hidden,),
        "dec_x": (hidden, 4 * hidden), "dec_h": (hidden, 4 * hidden), "dec_b": (4 * hidden,), "out_w": (hidden, features), "out_b": (features,),
    }
    out = {k: r.uniform(-1, 1, s) / np.sqrt(latent if k.startswith("from") else hidden) for k, s in shapes.items()}
    for b in ("enc_b", "dec_b"):
        out[b][hidden : 2 * hidden] += 1.0
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _lstm(inputs: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """States (n, steps, hidden) over ``inputs`` (n, steps, width), and what going back needs."""
    n, steps, _ = inputs.shape
    size = wh.shape[0]
    h, c, states, tape = np.zeros((n, size)), np.zeros((n, size)), np.empty((n, steps, size)), []
    driven = inputs @ wx + b
    for t in range(steps):
        i, f, g, o = np.split(driven[:, t] + h @ wh, 4, axis=1)
        i, f, g, o = _sigmoid(i), _sigmoid(f), np.tanh(g), _sigmoid(o)
        before, held = h, c
        c = f * held + i * g
        squashed = np.tanh(c)
        h = o * squashed
        states[:, t] = h
        tape.append((before, held, i, f, g, o, squashed))
    return states, tape


def _lstm_back(d_states: np.ndarray, inputs: np.ndarray, tape: list, wx: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of (inputs, wx, wh, b) from those of all states."""
    n, steps, size = d_states.shape
    d_driven, d_wh, d_h, d_c = np.empty((n, steps, 4 * size)), np.zeros_like(wh), np.zeros((n, size)), np.zeros((n, size))
    for t in range(steps - 1, -1, -1):
        before, held, i, f, g, o, squashed = tape[t]
        d_h = d_h + d_states[:, t]
        d_c = d_c + d_h * o * (1 - squashed**2)
        d = np.concatenate([d_c * g * i * (1 - i), d_c * held * f * (1 - f), d_c * i * (1 - g**2), d_h * squashed * o * (1 - o)], axis=1)
        d_driven[:, t] = d
        d_wh += before.T @ d
        d_h, d_c = d @ wh.T, d_c * f
    flat = d_driven.reshape(n * steps, -1)
    return d_driven @ wx.T, inputs.reshape(n * steps, -1).T @ flat, d_wh, flat.sum(axis=0)


def _forward(w: Weights, x: np.ndarray) -> tuple[np.ndarray, tuple]:
    coded, tape = _lstm(x, w["enc_x"], w["enc_h"], w["enc_b"])
    latent = coded[:, -1] @ w["to_w"] + w["to_b"]
    given = np.repeat((latent @ w["from_w"] + w["from_b"])[:, None], x.shape[1], axis=1)
    decoded, back = _lstm(given, w["dec_x"], w["dec_h"], w["dec_b"])
    return decoded @ w["out_w"] + w["out_b"], (coded, tape, latent, given, decoded, back)


def errors(w: Weights, x: np.ndarray) -> np.ndarray:
    """Mean squared error of each window of ``x`` (n, steps, features)."""
    return ((_forward(w, x)[0] - x) ** 2).mean(axis=(1, 2)) if len(x) else np.zeros(0)


def loss_and_gradient(w: Weights, x: np.ndarray) -> tuple[float, Weights]:
    """Sum over windows of their mean squared error, and its gradient."""
    rebuilt, (coded, tape, latent, given, decoded, back) = _forward(w, x)
    n, steps, features = x.shape
    off = rebuilt - x
    d_out = 2 * off / (steps * features)
    g = {"out_w": decoded.reshape(n * steps, -1).T @ d_out.reshape(n * steps, -1), "out_b": d_out.sum(axis=(0, 1))}
    d_given, g["dec_x"], g["dec_h"], g["dec_b"] = _lstm_back(d_out @ w["out_w"].T, given, back, w["dec_x"], w["dec_h"])
    d_from = d_given.sum(axis=1)
    g["from_w"], g["from_b"] = latent.T @ d_from, d_from.sum(axis=0)
    d_latent = d_from @ w["from_w"].T
    g["to_w"], g["to_b"] = coded[:, -1].T @ d_latent, d_latent.sum(axis=0)
    d_coded = np.zeros_like(coded)
    d_coded[:, -1] = d_latent @ w["to_w"].T
    _, g["enc_x"], g["enc_h"], g["enc_b"] = _lstm_back(d_coded, x, tape, w["enc_x"], w["enc_h"])
    return float((off**2).mean(axis=(1, 2)).sum()), {k: g[k] for k in w}


def sequences(windowed: DataFrame, columns: list[str]) -> DataFrame:
    """window_id, y and x, the features of a window step by step, from rows (window_id, pos, label, features)."""
    step = F.struct("pos", F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))
    x = F.flatten(F.transform(F.array_sort(F.collect_list(step)), lambda s: s["v"]))
    return windowed.groupBy("window_id").agg((F.avg("label") > 0.1).cast("int").alias("y"), x.alias("x"))


def _arrays(b: pa.RecordBatch, column: int, features: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, windows) of a batch, some windows at a time."""
    for a in range(0, b.num_rows, CHUNK):
        part = b.column(column).slice(a, CHUNK)
        yield a, np.asarray(part.flatten(), float).reshape(len(part), -1, features)


def _pack(w: Weights) -> np.ndarray:
    return np.concatenate([v.ravel() for v in w.values()])


def _unpack(flat: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k, v in like.items():
        out[k] = flat[at : at + v.size].reshape(v.shape)
        at += v.size
    return out


def _step(batch: DataFrame, w: Weights) -> tuple[float, int, np.ndarray]:
    """(loss, windows, gradient), each summed over a batch."""
    features, size = w["enc_x"].shape[0], sum(v.size for v in w.values())

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2)
        for b in batches:
            for _, x in _arrays(b, 0, features):
                loss, g = loss_and_gradient(w, x)
                total += np.concatenate([[loss, len(x)], _pack(g)])
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2)
        for b in batches:
            total += np.asarray(b.column(0).flatten(), float).reshape(b.num_rows, -1).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["v"])

    sums = batch.select("x").mapInArrow(own, "v array<double>").coalesce(max(1, ADDERS)).mapInArrow(add, "v array<double>")
    total = np.sum([r.v for r in sums.collect()], axis=0)  # at most ADDERS rows of the size of the weights
    return float(total[0]), int(total[1]), total[2:]


class Training:
    """A training run whose state (weights, moments, steps, losses) is a table for each finished epoch under ``at``."""

    def __init__(self, spark: SparkSession, at: str | None = None, batch: int = 128, rate: float = 1e-3, hidden: int = 64, latent: int = 16, seed: int = 42):
        self.spark, self.at = spark, at or scratch_path(spark, "training")
        self.batch, self.rate, self.hidden, self.latent, self.seed = batch, rate, hidden, latent, seed

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def state(self) -> tuple[int, Weights, Weights, Weights, int, list[float]] | None:
        """(epoch, weights, first and second moments, steps, losses) of the last finished epoch."""
        epoch = 0
        while self._exists(f"{self.at}/epoch-{epoch + 1}"):
            epoch += 1
        if not epoch:
            return None
        rows = sorted(self.spark.read.parquet(f"{self.at}/epoch-{epoch}").collect(), key=lambda r: r.place)  # a row for each weight matrix
        take = lambda c: {r.name: np.array(r[c]).reshape(r["shape"]) for r in rows if r["shape"]}
        log = rows[-1]
        return epoch, take("weights"), take("first"), take("second"), int(log.weights[0]), list(log.first)

    def _save(self, epoch: int, w: Weights, first: Weights, second: Weights, steps: int, losses: list[float]) -> None:
        rows = [(k, name, list(v.shape), v.ravel().tolist(), first[name].ravel().tolist(), second[name].ravel().tolist()) for k, (name, v) in enumerate(w.items())]
        rows.append((len(rows), "log", [], [float(steps)], losses, []))
        schema = "place int, name string, shape array<int>, weights array<double>, first array<double>, second array<double>"
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{self.at}/epoch-{epoch}")

    def fit(self, normal: DataFrame, features: int, epochs: int = 10) -> tuple[Weights, list[float]]:
        """Weights and the mean loss of every epoch, weighted by windows, from ``normal`` (window_id, x); goes on where a run stopped."""
        data = f"{self.at}/windows"
        if not self._exists(data):
            n = normal.count()
            if not n:
                raise ValueError("no windows to learn from")
            parts = min(MAX_BATCHES, -(-n // self.batch))
            normal.select("x", F.pmod(F.xxhash64("window_id", F.lit(self.seed)), F.lit(parts)).alias("batch")).write.mode("overwrite").partitionBy("batch").parquet(data)
        batches = sorted(r.batch for r in self.spark.read.parquet(data).select("batch").distinct().collect())  # at most MAX_BATCHES
        zero = new_weights(features, self.hidden, self.latent, self.seed)
        epoch, w, first, second, steps, losses = self.state() or (0, zero, *({k: np.zeros_like(v) for k, v in zero.items()} for _ in range(2)), 0, [])
        w, first, second = ({k: x[k] for k in zero} for x in (w, first, second))
        while epoch < epochs:
            epoch += 1
            loss = count = 0
            for k in np.random.default_rng([self.seed, epoch]).permutation(len(batches)):
                part, n, flat = _step(self.spark.read.parquet(data).where(F.col("batch") == batches[k]), w)
                g, steps = _unpack(flat / n, w), steps + 1
                for name in w:
                    first[name] = 0.9 * first[name] + 0.1 * g[name]
                    second[name] = 0.999 * second[name] + 0.001 * g[name] ** 2
                    w[name] = w[name] - self.rate * (first[name] / (1 - 0.9**steps)) / (np.sqrt(second[name] / (1 - 0.999**steps)) + 1e-8)
                loss, count = loss + part, count + n
            losses = [*losses, loss / count]
            self._save(epoch, w, first, second, steps, losses)
        return w, losses


def score(windows: DataFrame, w: Weights) -> DataFrame:
    """window_id, y, score of ``windows`` (window_id, y, x); weights are of a fixed size and travel with the tasks."""
    features = w["enc_x"].shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [errors(w, x) for _, x in _arrays(b, 2, features)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(found) if found else [], pa.float64())], ["window_id", "y", "score"])

    return windows.select(F.col("window_id").cast("long").alias("window_id"), F.col("y").cast("int").alias("y"), "x").mapInArrow(run, "window_id long, y int, score double")
