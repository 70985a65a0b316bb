"""Bus statistics of frame tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bus_summary(frames: DataFrame) -> DataFrame:
    """One row: frames, duration, rate, distinct identifiers, normal and attack frames. Rounding is half-even."""
    total = F.count("*")
    span = F.max("timestamp") - F.min("timestamp")
    return frames.agg(
        total.alias("total_frames"), F.bround(span, 2).alias("duration_seconds"),
        F.coalesce(F.bround(F.try_divide(total.cast("double"), F.nullif(span, F.lit(0.0))), 1), F.lit(0.0)).alias("frames_per_second"),
        F.count_distinct("can_id").alias("unique_can_ids"), F.count_if(F.col("label") == 0).alias("normal_frames"), F.count_if(F.col("label") == 1).alias("attack_frames"),
    )


def top_can_ids(frames: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent identifiers and their share of all traffic; the total is one extra row, not a window over all."""
    total = frames.agg(F.count("*").alias("_total"))
    counts = frames.groupBy("can_id").agg(F.count("*").alias("n_frames")).orderBy(F.desc("n_frames"), "can_id").limit(k)
    return counts.join(F.broadcast(total)).select("can_id", "n_frames", F.round(100 * F.col("n_frames") / F.col("_total"), 6).alias("share_percent"))


def dataset_stats(frames: DataFrame) -> DataFrame:
    total, attacks = F.count("*"), F.count_if(F.col("label") == 1)
    return frames.agg(
        total.alias("total_frames"), attacks.alias("attack_frames"), (total - attacks).alias("normal_frames"),
        F.coalesce(F.bround(F.try_divide(100.0 * attacks, total), 2), F.lit(0.0)).alias("attack_ratio_percent"), F.count_distinct("can_id").alias("unique_ids"),
    )


def dlc_histogram(frames: DataFrame) -> DataFrame:
    return frames.groupBy("dlc").agg(F.count("*").alias("n_frames")).orderBy("dlc")
