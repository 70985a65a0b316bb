"""Driver tables standing in for vehicle data, in Spark and as SQL with the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from torquelake.sources.frames import index_frames


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as CAN frames, not yet indexed."""
    e = table(spark, sf_dir, "events")
    dlc = (F.col("event_id") % 9).cast("int")
    data = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.when(j < dlc, ((F.col("event_id") * (j + 1) * 7) % 256).cast("int")).otherwise(F.lit(0)))
    return e.select(
        "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"), F.hex("user_id").alias("can_id"), dlc.alias("dlc"), data.alias("data"),
        ((F.col("event_type") == "error") & (F.col("value") > 40)).cast("int").alias("label"), "value", "user_id",
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_frames(raw_frames(spark, sf_dir), "event_id")


FRAMES_SQL = """frames AS (
  SELECT row_number() OVER (ORDER BY event_id) - 1 AS frame_idx, event_id, epoch_us(ts) / 1e6 AS "timestamp", printf('%X', user_id) AS can_id, CAST(event_id % 9 AS INTEGER) AS dlc,
    list_transform(range(8), lambda j: CASE WHEN j < event_id % 9 THEN CAST((event_id * (j + 1) * 7) % 256 AS INTEGER) ELSE 0 END) AS data,
    CASE WHEN event_type = 'error' AND value > 40 THEN 1 ELSE 0 END AS label, value, user_id
  FROM events)"""
FEATURES_SQL = FRAMES_SQL + """, feats AS (
  SELECT *, ln(1 + greatest(coalesce("timestamp" - lag("timestamp") OVER (ORDER BY frame_idx), 0), 0)) AS inter_arrival,
    count(*) OVER (PARTITION BY can_id ORDER BY frame_idx RANGE BETWEEN 999 PRECEDING AND CURRENT ROW) / least(frame_idx + 1, 1000)::DOUBLE AS id_freq,
    dlc / 8.0::DOUBLE AS dlc_n FROM frames), n AS (SELECT count(*) AS n FROM frames)"""
WINDOWED_SQL = FEATURES_SQL + """, windowed AS (
  SELECT f.*, frame_idx // 32 - j AS window_id FROM feats f, n, (VALUES (0), (1)) v(j)
  WHERE frame_idx // 32 - j >= 0 AND (frame_idx // 32 - j) * 32 + 64 <= n.n)"""
