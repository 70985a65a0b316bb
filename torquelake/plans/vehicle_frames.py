"""Queries on frames, windows and detection metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from torquelake.operators import bus, detect, windows
from torquelake.plans.proxy import FEATURES_SQL, FRAMES_SQL, WINDOWED_SQL, frames, raw_frames, table
from torquelake.sources import frames as source

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("bus_summary", f"""WITH {FRAMES_SQL} SELECT count(*) AS total_frames, round_even(max("timestamp") - min("timestamp"), 2) AS duration_seconds,
  round_even(count(*) / (max("timestamp") - min("timestamp")), 1) AS frames_per_second, count(DISTINCT can_id) AS unique_can_ids,
  count(*) FILTER (label = 0) AS normal_frames, count(*) FILTER (label = 1) AS attack_frames FROM frames""")
def bus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bus.bus_summary(raw_frames(spark, sf_dir))


@query("top_can_ids", f"""WITH {FRAMES_SQL} SELECT can_id, count(*) AS n_frames, round(100 * count(*) / (SELECT count(*) FROM frames)::DOUBLE, 6) AS share_percent
  FROM frames GROUP BY can_id ORDER BY 2 DESC, 1 LIMIT 10""")
def top_can_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bus.top_can_ids(raw_frames(spark, sf_dir))


@query("id_share", f"""WITH {FRAMES_SQL} SELECT can_id, count(*) AS n_frames, round(100 * count(*) / (SELECT count(*) FROM frames)::DOUBLE, 6) AS share_percent
  FROM frames GROUP BY can_id ORDER BY 2 DESC, 1 LIMIT 5""")
def id_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bus.top_can_ids(raw_frames(spark, sf_dir), 5)


@query("dataset_stats", f"""WITH {FRAMES_SQL} SELECT count(*) AS total_frames, count(*) FILTER (label = 1) AS attack_frames, count(*) FILTER (label = 0) AS normal_frames,
  round_even(100.0::DOUBLE * count(*) FILTER (label = 1) / count(*), 2) AS attack_ratio_percent, count(DISTINCT can_id) AS unique_ids FROM frames""")
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bus.dataset_stats(raw_frames(spark, sf_dir))


@query("dlc_histogram", f"WITH {FRAMES_SQL} SELECT dlc, count(*) AS n_frames FROM frames GROUP BY dlc ORDER BY dlc")
def dlc_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bus.dlc_histogram(raw_frames(spark, sf_dir))


_LINE = """lines AS (SELECT event_id, concat_ws(',', printf('%.6f', "timestamp"), lower(can_id), dlc::VARCHAR, CASE WHEN dlc > 0 THEN array_to_string(list_transform(data[1:dlc], lambda b: printf('%02x', b)), ',') END,
  CASE WHEN label = 1 THEN 'T' ELSE 'R' END) AS "value" FROM frames)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = raw_frames(spark, sf_dir)
    data = F.when(F.col("dlc") > 0, F.array_join(F.transform(F.slice("data", 1, F.col("dlc")), lambda b: F.lower(F.lpad(F.hex(b), 2, "0"))), ","))
    return f.select("event_id", F.concat_ws(",", F.format_string("%.6f", "timestamp"), F.lower("can_id"), F.col("dlc").cast("string"), data, F.when(F.col("label") == 1, "T").otherwise("R")).alias("value"))


@query("csv_variable_dlc", f"""WITH {FRAMES_SQL} SELECT event_id, round("timestamp", 3) AS "timestamp", can_id, dlc, array_to_string(data, ' ') AS payload, label FROM frames""")
def csv_variable_dlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = source.parse_variable(_lines(spark, sf_dir))
    return p.select("event_id", F.round("timestamp", 3).alias("timestamp"), "can_id", "dlc", F.array_join(F.col("data").cast("array<string>"), " ").alias("payload"), "label")


_FIXED = f"""WITH {FRAMES_SQL} SELECT event_id, can_id, CASE WHEN dlc = 8 THEN CASE WHEN label = 1 THEN 'T' ELSE 'R' END ELSE '' END AS flag, dlc, array_to_string(data[1:dlc], ' ') AS payload FROM frames"""


def _fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.parse_fixed(_lines(spark, sf_dir))


@query("csv_fixed_width", _FIXED)
def csv_fixed_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    bytes_ = source.payload_bytes(F.col("dlc"), [F.col(f"d{i}") for i in range(8)])
    return _fixed(spark, sf_dir).select("event_id", "can_id", "flag", "dlc", F.array_join(bytes_.cast("array<string>"), " ").alias("payload"))


@query("filter_normal", f"SELECT event_id, can_id FROM ({_FIXED}) WHERE flag = 'R'")
def filter_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.filter_normal(_fixed(spark, sf_dir)).select("event_id", "can_id")


@query("filter_attack", f"SELECT event_id, can_id FROM ({_FIXED}) WHERE flag = 'T'")
def filter_attack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.filter_attack(_fixed(spark, sf_dir)).select("event_id", "can_id")


@query("inter_arrival", f"WITH {FEATURES_SQL} SELECT frame_idx, round(inter_arrival, 6) AS inter_arrival FROM feats")
def inter_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.add_features(frames(spark, sf_dir)).select("frame_idx", F.round("inter_arrival", 6).alias("inter_arrival"))


@query("id_freq_rolling", f"WITH {FEATURES_SQL} SELECT frame_idx, can_id, round(id_freq, 9) AS id_freq FROM feats")
def id_freq_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Blocks of 4096 rows, so that block borders are exercised at small scale.
    return windows.add_features(frames(spark, sf_dir), block=4096).select("frame_idx", "can_id", F.round("id_freq", 9).alias("id_freq"))


@query("temporal_split", f"""WITH {FRAMES_SQL}, n AS (SELECT CAST(trunc(count(*) * 0.7::DOUBLE) AS BIGINT) AS cut FROM frames)
  SELECT CASE WHEN frame_idx < cut THEN 'train' ELSE 'test' END AS side, count(*) AS n_frames, min(event_id) AS first_event, max(event_id) AS last_event,
    max(CASE WHEN frame_idx < cut THEN frame_idx ELSE frame_idx - cut END) AS last_idx FROM frames, n GROUP BY 1""")
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    train, test = windows.temporal_split(f, f.count())
    both = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return both.groupBy("side").agg(F.count("*").alias("n_frames"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.max("frame_idx").alias("last_idx"))


def _windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return windows.sliding_windows(windows.feature_columns(windows.add_features(f)), f.count())


@query("sliding_windows", f"WITH {WINDOWED_SQL} SELECT window_id, count(*) AS n_frames, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame FROM windowed GROUP BY window_id")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windowed(spark, sf_dir).groupBy("window_id").agg(F.count("*").alias("n_frames"), F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"))


_LABELS = f"WITH {WINDOWED_SQL} SELECT window_id, count(*) AS n_frames, round(avg(label), 6) AS attack_share, CAST(avg(label) > 0.1::DOUBLE AS INTEGER) AS y FROM windowed GROUP BY window_id"


@query("window_labels", _LABELS)
def window_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.window_labels(_windowed(spark, sf_dir)).withColumn("attack_share", F.round("attack_share", 6))


@query("normal_windows", f"SELECT window_id FROM ({_LABELS}) WHERE y = 0")
def normal_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.window_labels(_windowed(spark, sf_dir)).where("y = 0").select("window_id")


# Features in whole millionths: their moments are exact, whatever the order of rows.
_MICRO = {"inter_arrival": "inter_arrival", "id_freq": "id_freq", "dlc_n": "dlc_n"} | {f"b{i}": f"data[{i + 1}] / 255.0::DOUBLE" for i in range(8)}
_STATS_SQL = f"""WITH {WINDOWED_SQL}, m AS (SELECT window_id, label, {', '.join(f"CAST(round(({v}) * 1000000) AS BIGINT) AS {k}" for k, v in _MICRO.items())} FROM windowed)
  SELECT window_id, {', '.join(f"sum({k})::DOUBLE / count(*) AS {k}_mean, sqrt(greatest(count(*) * sum({k} * {k}) - sum({k}) * sum({k}), 0)::DOUBLE) / count(*) AS {k}_std, min({k}) AS {k}_min, max({k}) AS {k}_max" for k in _MICRO)},
    CAST(avg(label) > 0.1::DOUBLE AS INTEGER) AS y FROM m GROUP BY window_id"""


@query("window_stats", _STATS_SQL)
def window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.feature_columns(_windowed(spark, sf_dir))
    return windows.window_stats(w.withColumns({c: F.round(F.col(c) * 1_000_000).cast("long") for c in windows.FEATURES}))


_SCALED = {k: v if k.startswith("b") else f'"{k}"' for k, v in _MICRO.items()}
#: Added before rounding, so that exact shares do not lie on a border of rounding, where the order of a sum would decide.
_OFF_BORDER = 0.00001 / 7
_PLACES = lambda v: f"round({v} + {_OFF_BORDER!r}::DOUBLE, 5)"
_SCALED_SQL = f"""WITH {WINDOWED_SQL}, m AS (SELECT window_id, label, {', '.join(f"{v} AS {k}" for k, v in _SCALED.items())} FROM windowed)
  SELECT window_id, {', '.join(f"{_PLACES(f'{sql}({k})')} AS {k}_{name}" for name, sql in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")) for k in _SCALED)},
    CAST(avg(label) > 0.1::DOUBLE AS INTEGER) AS y FROM m GROUP BY window_id"""


@query("window_stats_scaled", _SCALED_SQL)
def window_stats_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics as the models take them, of the scaled features, to five places."""
    w = windows.window_stats(windows.feature_columns(_windowed(spark, sf_dir)))
    return w.select(*[c if c in ("window_id", "y") else F.round(F.col(c) + _OFF_BORDER, 5).alias(c) for c in w.columns])


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_frames(spark, sf_dir).select("event_id", F.col("value").alias("score"), F.col("label").alias("y"))


@query("calibrate_upper", f"WITH {FRAMES_SQL} SELECT round(quantile_cont(value, 0.98), 6) AS threshold FROM frames")
def calibrate_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.calibrate_upper(_scores(spark, sf_dir)).select(F.round("threshold", 6).alias("threshold"))


@query("calibrate_bilateral", f"WITH {FRAMES_SQL} SELECT round(quantile_cont(value, 0.01), 6) AS low, round(quantile_cont(value, 0.99), 6) AS high FROM frames")
def calibrate_bilateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.calibrate_bilateral(_scores(spark, sf_dir)).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("predict_upper", f"WITH {FRAMES_SQL}, t AS (SELECT quantile_cont(value, 0.98) AS th FROM frames) SELECT event_id, CAST(value > th AS INTEGER) AS pred FROM frames, t")
def predict_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores(spark, sf_dir)
    return s.join(F.broadcast(detect.calibrate_upper(s))).select("event_id", detect.predict_upper(F.col("score"), F.col("threshold")).alias("pred"))


_BAND = f"WITH {FRAMES_SQL}, t AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM frames)"


@query("predict_bilateral", f"{_BAND} SELECT event_id, CAST(value < lo OR value > hi AS INTEGER) AS pred FROM frames, t")
def predict_bilateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores(spark, sf_dir)
    return s.join(F.broadcast(detect.calibrate_bilateral(s))).select("event_id", detect.predict_bilateral(F.col("score"), F.col("low"), F.col("high")).alias("pred"))


@query("band_distance", f"{_BAND} SELECT event_id, round(greatest(lo - value, value - hi), 6) AS distance FROM frames, t")
def band_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores(spark, sf_dir)
    return s.join(F.broadcast(detect.calibrate_bilateral(s))).select("event_id", F.round(detect.band_distance(F.col("score"), F.col("low"), F.col("high")), 6).alias("distance"))


@query("confusion_metrics", f"""{_BAND}, p AS (SELECT label AS y, CAST(value < lo OR value > hi AS INTEGER) AS pred FROM frames, t),
  c AS (SELECT count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 0 AND pred = 0) AS tn FROM p)
  SELECT tp, fp, fn, tn, round_even(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 4) AS "precision", round_even(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 4) AS recall,
    round_even(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 4) AS f1 FROM c""")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores(spark, sf_dir)
    p = s.join(F.broadcast(detect.calibrate_bilateral(s))).withColumn("pred", detect.predict_bilateral(F.col("score"), F.col("low"), F.col("high")))
    return detect.confusion_metrics(p)


@query("roc_auc", """WITH d AS (SELECT quality AS y, n_chars AS s FROM labels JOIN documents USING (doc_id)),
  r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r FROM d)
  SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))::DOUBLE, 6) AS auc FROM r""")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return detect.roc_auc(d.select(F.col("quality").alias("y"), F.col("n_chars").cast("double").alias("score")))
