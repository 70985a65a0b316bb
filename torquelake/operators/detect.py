"""Threshold calibration, predictions and detection metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from torquelake.operators import quantiles
from torquelake.session import stored


def calibrate_upper(scores: DataFrame, column: str = "score", percentile: float = 98.0) -> DataFrame:
    """Exact, linearly interpolated percentile."""
    if not 0 < percentile < 100:
        raise ValueError("percentile must lie between 0 and 100")
    return quantiles.exact(scores, column, {"threshold": percentile / 100})


def calibrate_bilateral(scores: DataFrame, column: str = "score", low: float = 1.0, high: float = 99.0) -> DataFrame:
    if not 0 <= low < high <= 100:
        raise ValueError("0 <= low < high <= 100")
    return quantiles.exact(scores, column, {"low": low / 100, "high": high / 100})


def predict_upper(score: Column, threshold: Column) -> Column:
    return (score > threshold).cast("int")


def predict_bilateral(score: Column, low: Column, high: Column) -> Column:
    return ((score < low) | (score > high)).cast("int")


def band_distance(score: Column, low: Column, high: Column) -> Column:
    return F.greatest(low - score, score - high)


def confusion_metrics(df: DataFrame, truth: str = "y", predicted: str = "pred") -> DataFrame:
    """Counts, precision, recall and F1 (0 where undefined), half-even to 4 places."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    c = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(
        "tp", "fp", "fn", "tn", F.bround(ratio(tp, tp + fp), 4).alias("precision"), F.bround(ratio(tp, tp + fn), 4).alias("recall"), F.bround(ratio(2 * tp, 2 * tp + fp + fn), 4).alias("f1")
    )


def roc_auc(df: DataFrame, score: str = "score", truth: str = "y") -> DataFrame:
    """Mann-Whitney AUC with average ranks for ties; NULL with one class only.

    Rows are first counted by distinct score, and running counts are taken per range of scores and
    then across ranges, so the global order is never built in one task.
    """
    by = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) == 0).alias("n"))
    ranged = stored(by.repartitionByRange("s").withColumn("_part", F.spark_partition_id()), "score-counts")
    inner = Window.partitionBy("_part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.withColumn("below", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    parts = ranged.groupBy("_part").agg(F.sum("n").alias("tn"))
    lower = parts.withColumn("base", F.coalesce(F.sum("tn").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "base")
    u = before.join(F.broadcast(lower), "_part").agg(F.sum(F.col("p") * (F.col("base") + F.col("below") + F.col("n") / 2)).alias("u"), F.sum("p").alias("np"), F.sum("n").alias("nn"))
    return u.select(F.round(F.try_divide(F.col("u"), F.col("np") * F.col("nn")), 6).alias("auc"))


def reconstruction_error(windowed: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Mean squared difference per window over positions and (column, reconstruction) pairs."""
    total = sum((F.pow(F.col(a) - F.col(b), 2) for a, b in pairs), F.lit(0.0))
    return windowed.groupBy("window_id").agg((F.sum(total) / (F.count("*") * len(pairs))).alias("score"))
