"""Event-time bus counts, and running a stream over what is there."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from torquelake.session import scratch_path

NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def windowed_counts(frames: DataFrame, time: str = "ts", window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Frames per event-time window and identifier, with a watermark for late rows."""
    return frames.withWatermark(time, late).groupBy(F.window(time, window), "can_id").agg(F.count("*").alias("n_frames")).select(F.col("window.start").alias("start"), "can_id", "n_frames")


def latest_counts(stream: DataFrame, keys: list[str], at: str | None = None) -> DataFrame:
    """Run an updating aggregation over all that is there; returns the last row of each key.

    Every micro-batch writes the rows it changed, so neither the driver nor a task holds the whole result, and state that
    the watermark has passed is dropped. A batch that runs again overwrites its own folder.
    """
    spark = stream.sparkSession
    path = at or scratch_path(spark, "stream")

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").foreachBatch(put).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(T.StructType(stream.schema.fields).add("batch", "long")).parquet(f"{path}/rows")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_v")).select(*keys, "_v.*")


def run_slices(slices: Iterable[DataFrame], build: Callable[[DataFrame], DataFrame], at: str | None = None) -> DataFrame:
    """Feed ``slices`` one by one to the stream ``build`` makes, restarting it from its checkpoint for each; returns its table."""
    out = None
    for rows in slices:
        spark: SparkSession = rows.sparkSession
        if out is None:
            path, schema = at or scratch_path(spark, "stream"), rows.schema
        rows.write.mode("append").parquet(f"{path}/in")
        # Processing-time timers ask for batches without data for ever; here they run with the next data.
        before = spark.conf.get(NO_DATA_BATCHES)
        spark.conf.set(NO_DATA_BATCHES, "false")
        try:
            out = build(spark.readStream.schema(schema).parquet(f"{path}/in"))
            q = out.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
            q.awaitTermination()
        finally:
            spark.conf.set(NO_DATA_BATCHES, before)
    if out is None:
        raise ValueError("no slices")
    return spark.read.schema(out.schema).parquet(f"{path}/out")
