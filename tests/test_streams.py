"""Streams with state against their batch forms, for several cuts into micro-batches, each a restart from the checkpoint."""

from __future__ import annotations

import collections
import random

import pytest
from pyspark.sql import functions as F

from torquelake.operators import protocol, windows
from torquelake.streaming import bus, stateful


def cut(df, order, at):
    edges = [-1, *at, 1 << 40]
    return [df.where((F.col(order) > a) & (F.col(order) <= b)) for a, b in zip(edges, edges[1:], strict=False)]


def bag(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


def wire(seed: int) -> list[tuple]:
    """Frames of three units: whole messages, lost and doubled frames, strays, unknown kinds, flow control."""
    r, rows = random.Random(seed), []
    for unit in ("a", "b", None):
        frames = []
        for _ in range(25):
            body = r.randbytes(r.choice([0, 1, 7, 8, 13, 14, 40, 130])).hex().upper()
            n = len(body) // 2
            if n <= 7:
                mine = [f"0{n}{body}".ljust(16, "A")]
            else:
                mine = [f"{0x1000 + n:04X}{body[:12]}"] + [f"2{(k + 1) % 16:X}{body[12 + 14 * k : 26 + 14 * k]}".ljust(16, "A") for k in range(-(-(n - 6) // 7))]
            match r.randrange(8):
                case 0:
                    mine.pop(r.randrange(len(mine)))
                case 1:
                    mine.insert(r.randrange(len(mine) + 1), r.choice(["2100000000000000", "F000000000000000", "2500000000000000"]))
                case 2:
                    mine.append("30000000AAAAAAAA")
            frames += mine
        rows += [(unit, i, f) for i, f in enumerate(frames)] + [(unit, len(frames), None)]
    return rows


@pytest.mark.parametrize("at", [[], [3, 40], [10, 11, 60]])
def test_reassembly(spark, at):
    frames = spark.createDataFrame(wire(len(at)), "unit string, i long, frame string")
    frames = frames.withColumn("unit", F.coalesce("unit", F.lit("none")))
    want = bag(protocol.reassemble(frames, "unit", "i"), "unit", "message", "payload", "error")
    assert {k[3] for k in want} >= {None, "no first frame", "bad sequence"}
    flush = spark.createDataFrame([("clock", 0, protocol.flow_control())], frames.schema)
    got = bus.run_slices([*cut(frames, "i", at), flush], lambda s: stateful.reassemble(s, "unit", "i", wait_ms=1))
    assert bag(got, "unit", "message", "payload", "error") == want


@pytest.mark.parametrize("at,size,stride", [([], 8, 4), ([5, 6, 70], 8, 4), ([30], 4, 9)])
def test_count_windows(spark, at, size, stride):
    rows = [(k, i, 10 * k + i) for k in range(2) for i in range(100 - 63 * k)]
    frames = spark.createDataFrame(rows, "bus long, at long, x long")
    want = sum((collections.Counter({(k, *r): n for r, n in bag(windows.sliding_windows(frames.where(f"bus = {k}").withColumn("frame_idx", F.col("at")), 100 - 63 * k, size, stride), "window_id", "pos", "at", "x").items()}) for k in range(2)), collections.Counter())
    got = bus.run_slices(cut(frames, "at", at), lambda s: stateful.count_windows(s, "bus", "at", size, stride))
    assert bag(got, "bus", "window_id", "pos", "at", "x") == want


@pytest.mark.parametrize("at", [[], [1, 33, 34, 150]])
def test_rolling_features(spark, at):
    r = random.Random(2)
    rows = [(i, i * 0.01 - (0.5 if i == 70 else 0), r.choice("abcde") if i < 120 else "z", 0) for i in range(200)]
    frames = spark.createDataFrame(rows, "i long, timestamp double, can_id string, bus long")
    batch = windows.add_features(frames.withColumn("frame_idx", F.col("i")), id_window=30)
    got = bus.run_slices(cut(frames, "i", at), lambda s: stateful.rolling_features(s, "bus", "i", window=30))
    near = lambda df: sorted((x.frame_idx, x.can_id, round(x.inter_arrival, 9), round(x.id_freq, 9)) for x in df.collect())
    assert near(got) == near(batch)


def test_latest_counts_are_those_of_the_whole(spark, tmp_path):
    at = f"file://{tmp_path}"
    for k in range(3):
        spark.range(100).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 3).cast("string").alias("can_id")).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema("ts timestamp, can_id string").option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    got = bus.latest_counts(bus.windowed_counts(stream, late="10 days"), ["start", "can_id"], f"{at}/run")
    assert got.agg(F.sum("n_frames")).first()[0] == 300
