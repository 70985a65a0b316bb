"""Frame features, temporal split and sliding count windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FEATURES = ["inter_arrival", "id_freq", "dlc_n", *[f"b{i}" for i in range(8)]]


def add_features(frames: DataFrame, id_window: int = 1000, block: int = 1 << 20) -> DataFrame:
    """inter_arrival = log1p of the gap to the previous frame; id_freq = share of the identifier in the last ``id_window`` frames.

    The gap looks back one row, so rows are windowed by block of ``frame_idx`` and each block's first
    row takes its predecessor from a join on the index: no task sees the whole log. The share is a
    RANGE frame over the global index; blocks of it overlap by ``id_window`` rows, so that one flooding
    identifier is spread over tasks as well.
    """
    if id_window < 1 or block < id_window:
        raise ValueError("id_window must be positive and at most a block")
    idx = F.col("frame_idx")
    blocked = frames.withColumn("_b", F.floor(idx / block))
    gap = Window.partitionBy("_b").orderBy("frame_idx")
    edges = frames.where((idx % block) == block - 1).select((idx + 1).alias("frame_idx"), F.col("timestamp").alias("_edge"))
    out = blocked.join(edges, "frame_idx", "left")
    out = out.withColumn("inter_arrival", F.log1p(F.greatest(F.coalesce(F.col("timestamp") - F.coalesce(F.lag("timestamp").over(gap), F.col("_edge")), F.lit(0.0)), F.lit(0.0))))
    # Rows at a block's end also appear, as history only, in the next block.
    copies = out.withColumn("_copy", F.explode(F.when((idx % block) >= block - id_window + 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    copies = copies.withColumn("_b", F.col("_b") + F.col("_copy"))
    recent = Window.partitionBy("can_id", "_b").orderBy("frame_idx").rangeBetween(-(id_window - 1), 0)
    freq = F.count("*").over(recent) / F.least(idx + 1, F.lit(id_window))
    return copies.withColumn("id_freq", freq).where("_copy = 0").drop("_b", "_copy", "_edge")


def feature_columns(frames: DataFrame) -> DataFrame:
    """The eleven model features, scaled: dlc by 8, bytes by 255."""
    return frames.withColumns({"dlc_n": F.col("dlc") / 8.0} | {f"b{i}": F.get("data", F.lit(i)) / 255.0 for i in range(8)})


def temporal_split(frames: DataFrame, n: int, ratio: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """The first int(n * ratio) frames and the rest, each indexed from 0."""
    if not 0 < ratio < 1:
        raise ValueError("ratio must lie between 0 and 1")
    cut = int(n * ratio)
    idx = F.col("frame_idx")
    return frames.where(idx < cut), frames.where(idx >= cut).withColumn("frame_idx", idx - cut)


def sliding_windows(frames: DataFrame, n: int, size: int = 64, stride: int = 32) -> DataFrame:
    """Each frame once per window it lies in (window_id, pos); windows that would pass the end are left out."""
    if size < 1 or stride < 1:
        raise ValueError("size and stride must be positive")
    back = -(-size // stride)
    k = F.floor(F.col("frame_idx") / stride)
    out = frames.withColumn("window_id", F.explode(F.transform(F.array(*[F.lit(i) for i in range(back)]), lambda i: k - i)))
    start = F.col("window_id") * stride
    keep = (F.col("window_id") >= 0) & (start + size <= n) & (F.col("frame_idx") < start + size)
    return out.where(keep).withColumn("pos", F.col("frame_idx") - start)


def window_labels(windowed: DataFrame, threshold: float = 0.1) -> DataFrame:
    """label 1 iff the share of attack frames is over (not at) the threshold."""
    share = F.avg("label")
    return windowed.groupBy("window_id").agg(F.count("*").alias("n_frames"), share.alias("attack_share"), (share > threshold).cast("int").alias("y"))


def window_stats(windowed: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """mean, population std, min, max of each feature per window, and the label, in one aggregation.

    Moments of whole numbers come from exact sums, so they do not depend on the order of rows.
    """
    cols = columns or FEATURES
    whole = {c for c, t in windowed.dtypes if t in ("int", "bigint")}

    def std(c: str):
        x = F.col(c).cast("long")
        exact = F.count("*") * F.sum(x * x) - F.sum(x) * F.sum(x)
        return F.sqrt(F.greatest(exact, F.lit(0)).cast("double")) / F.count("*") if c in whole else F.stddev_pop(c)

    aggs = [f(c).alias(f"{c}_{n}") for n, f in (("mean", F.avg), ("std", std), ("min", F.min), ("max", F.max)) for c in cols]
    return windowed.groupBy("window_id").agg(*aggs, (F.avg("label") > 0.1).cast("int").alias("y"))
