"""Queries on signal decoding, validation and freeze-frame correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from torquelake.functions import dims
from torquelake.operators import protocol, signals
from torquelake.plans.proxy import FRAMES_SQL, frames, raw_frames, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


#: dbc, frame_id, message, signal, pos, start_bit, length, byte_order, signed, scale, offset, minimum, maximum
DEFINITIONS = [
    *[("hyundai_a.dbc", i, f"EMS{i}", *s) for i in range(1, 60) for s in (("N", 0, 7, 16, "big", False, 0.25, 0.0, 0.0, 8000.0), ("VS", 1, 16, 8, "little", False, 1.0, 0.0, 0.0, 254.0), ("TEMP_ENG", 2, 24, 8, "little", False, 0.75, -48.0, -48.0, 143.0))],
    *[("hyundai_b.dbc", i, f"TCU{i}", *s) for i in range(30, 120) for s in (("TQI", 0, 8, 12, "little", True, 0.05, 0.0, 10.0, 100.0), ("BAT_VOLT", 1, 39, 8, "big", False, 0.1, 2.0, 0.0, 20.0))],
    *[("toyota_pt.dbc", i, f"PT{i}", "TPS", 0, 3, 7, "little", False, 0.5, 0.0, 0.0, 100.0) for i in range(500, 520)],
]


def definitions(spark: SparkSession) -> DataFrame:
    cols = "dbc string, frame_id long, message string, signal string, pos int, start_bit int, length_bits int, byte_order string, is_signed boolean, scale double, offset double, minimum double, maximum double"
    return spark.createDataFrame(DEFINITIONS, cols).withColumn("choices", F.lit(None).cast("map<long,string>"))


def _bit(n: int) -> str:
    return f"(data[{n // 8 + 1}] >> {n % 8} & 1)"


def _raw_sql(start: int, length: int, order: str, signed: bool) -> str:
    """Sum of the signal's bits by their place, least first (little) or along the big-endian walk."""
    bits = [start + i for i in range(length)]
    if order == "big":
        walk = [b * 8 + i for b in range(8) for i in range(7, -1, -1)]
        at = walk.index(start)
        bits = walk[at : at + length][::-1]
    total = " + ".join(f"{_bit(b)}::BIGINT * {1 << i}" for i, b in enumerate(bits))
    return f"({total} - {_bit(bits[-1])}::BIGINT * {1 << length})" if signed else f"({total})"


_KINDS = sorted({d[3:10] + (d[10],) for d in DEFINITIONS})
_DBC_SQL = dims.sql_values("dbc", "dbc, frame_id, message, signal, scale, off, lo, hi", [(d[0], d[1], d[2], d[3], d[9], d[10], d[11], d[12]) for d in DEFINITIONS])
_SIGNALS = f"""{FRAMES_SQL}, {_DBC_SQL}, sig AS (SELECT frame_idx, "timestamp", dbc.dbc, message, can_id, signal,
  CASE signal {' '.join(f"WHEN '{k[0]}' THEN {_raw_sql(k[2], k[3], k[4], k[5])} * {k[6]!r}::DOUBLE + {k[7]!r}::DOUBLE" for k in _KINDS)} END AS value FROM frames JOIN dbc ON user_id = frame_id)"""


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.decode(frames(spark, sf_dir), definitions(spark))


@query("dbc_decode", f"WITH {_SIGNALS} SELECT frame_idx, dbc, message, signal, round(value, 6) AS value FROM sig")
def dbc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select("frame_idx", "dbc", "message", "signal", F.round("value", 6).alias("value"))


_COVER = f"""{FRAMES_SQL}, {_DBC_SQL}, cov AS (SELECT dbc, (SELECT count(DISTINCT can_id) FROM frames) AS observed, count(DISTINCT frame_id) AS known,
  count(DISTINCT frame_id) FILTER (frame_id IN (SELECT user_id FROM frames)) AS matched FROM dbc GROUP BY dbc)"""
_COVER_COLS = "dbc, observed, known, matched, round_even(100.0::DOUBLE * matched / observed, 1) AS coverage_percent"


@query("dbc_coverage", f"WITH {_COVER} SELECT {_COVER_COLS} FROM cov")
def dbc_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.coverage(raw_frames(spark, sf_dir), definitions(spark))


@query("dbc_autoselect", f"WITH {_COVER} SELECT {_COVER_COLS} FROM cov ORDER BY matched DESC, dbc LIMIT 1")
def dbc_autoselect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.best_dbc(dbc_coverage(spark, sf_dir))


@query("signal_summary", f"""WITH {_SIGNALS} SELECT signal, count(*) AS "count", round(min(value), 4) AS "min", round(max(value), 4) AS "max", round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std FROM sig GROUP BY signal""")
def signal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals.signal_summary(_signals(spark, sf_dir), 9)
    return s.select("signal", "count", *[F.round(c, 4).alias(c) for c in ("min", "max", "mean", "std")])


@query("extraction_counters", f"WITH {_SIGNALS} SELECT count(DISTINCT frame_idx) AS frames_decoded, count(DISTINCT message) AS messages, count(DISTINCT signal) AS signals, count(*) AS datapoints FROM sig")
def extraction_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.extraction_counters(_signals(spark, sf_dir))


@query("physical_validation", f"""WITH {_SIGNALS}, {dims.sql_values('rng', 'signal, lo, hi, unit', [(k, *v) for k, v in dims.PHYSICAL_RANGES.items()])}
  SELECT sig.signal, unit, count(*) AS samples, round_even(min(value), 2) AS "min", round_even(max(value), 2) AS "max", round_even(100 * count(*) FILTER (value BETWEEN lo AND hi) / count(*)::DOUBLE, 1) AS in_range_percent,
    CASE WHEN bool_and(value BETWEEN lo AND hi) THEN 'OK' ELSE 'CHECK' END AS status FROM sig JOIN rng ON sig.signal = rng.signal GROUP BY ALL""")
def physical_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.physical_validation(_signals(spark, sf_dir)).drop("mean")


@query("signal_stats", f"""WITH {_SIGNALS} SELECT signal, round(avg(value), 4) AS mean, round(coalesce(stddev_samp(value), 0), 4) AS std, round(min(value), 4) AS "min", round(max(value), 4) AS "max", round(max_by(value, frame_idx * 1000 + ascii(dbc[9])), 4) AS latest, count(*) AS "count" FROM sig GROUP BY signal""")
def signal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals.signal_stats(_signals(spark, sf_dir))
    return s.select("signal", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max", "latest")], "count")


@query("signals_rebased", f"""WITH {_SIGNALS} SELECT frame_idx, dbc, signal, round("timestamp" - min("timestamp") OVER (PARTITION BY signal), 3) AS t FROM sig""")
def signals_rebased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.rebased(_signals(spark, sf_dir)).select("frame_idx", "dbc", "signal", F.round("t", 3).alias("t"))


@query("implausible", f"""WITH {_SIGNALS}, d AS (SELECT signal, any_value(scale) AS scale, any_value(off) AS off, any_value(lo) AS lo FROM dbc GROUP BY signal)
  SELECT sig.signal, round_even(min(value), 1) AS observed_min, round_even(max(value), 1) AS observed_max, CASE WHEN abs(off) > 40 THEN 'large offset' WHEN avg(value) < lo THEN 'below declared minimum' ELSE 'OK' END AS hypothesis
  FROM sig JOIN d ON sig.signal = d.signal GROUP BY sig.signal, off, lo""")
def implausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.implausible(_signals(spark, sf_dir), definitions(spark)).drop("raw_min", "raw_max")


_DEFINED = dims.sql_values("defs", "dbc, frame_id, message, signal, pos, start_bit, length_bits, byte_order, is_signed, factor, off, lo, hi", DEFINITIONS)
_LOOKUP = f"""WITH {_SIGNALS}, {_DEFINED}, asked AS (SELECT signal FROM sig UNION SELECT event_type FROM events),
  d AS (SELECT * FROM defs QUALIFY row_number() OVER (PARTITION BY signal ORDER BY dbc, frame_id, pos) = 1)
  SELECT a.signal, message, printf('%X', frame_id) AS can_id_hex, start_bit, length_bits, byte_order, is_signed, factor, lo AS declared_min, hi AS declared_max, message IS NOT NULL AS found,
    CASE WHEN message IS NULL THEN 'Signal ' || chr(39) || a.signal || chr(39) || ' not in DBC' END AS error
  FROM asked a LEFT JOIN d ON a.signal = d.signal"""


@query("signal_lookup", _LOOKUP)
def signal_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signals of the traffic, and the kinds of event, which no file defines."""
    asked = _signals(spark, sf_dir).select("signal").union(table(spark, sf_dir, "events").select("event_type"))
    return signals.lookup(definitions(spark), asked).drop("offset", "unit")


_FAULTS = [("P0301", "engine_rpm", 617), ("P0301", "coolant_temp", 92), ("P0301", "vehicle_speed", 0), ("P0401", "engine_rpm", 1850), ("P0401", "coolant_temp", 88), ("P0401", "vehicle_speed", 45), ("P2002", "engine_rpm", 2400), ("P2002", "coolant_temp", 95), ("P2002", "vehicle_speed", 70)]
_CAND = dims.sql_values("cand", "name, signal", [(c, v[0]) for c, v in dims.FREEZE_SIGNALS.items()])


@query("freeze_correlation", f"""WITH {_SIGNALS}, {_CAND}, {dims.sql_values('ff', 'code, name, v', _FAULTS)}, st AS (SELECT signal, avg(value) AS m, stddev_samp(value) AS s, min(value) AS lo, max(value) AS hi FROM sig GROUP BY signal)
  SELECT code, ff.name AS freeze_condition, v AS freeze_value, st.signal AS matched_signal, round((v - m) / s, 2) AS z_score, v BETWEEN lo AND hi AS within_live_range FROM ff JOIN cand ON ff.name = cand.name JOIN st ON st.signal = cand.signal""")
def freeze_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    faults = protocol.full_scan(spark)
    return signals.freeze_correlation(faults, signals.signal_stats(_signals(spark, sf_dir))).drop("z_note", "interpretation")


@query("freeze_context", f"WITH {dims.sql_values('n', 'code, notes', [('P0301', "defaut au ralenti; moteur chaud; vehicule a l'arret"), ('P0401', 'defaut en regime intermediaire; vehicule en mouvement (45 km/h)'), ('P2002', 'defaut en charge / haut regime; moteur chaud; vehicule en mouvement (70 km/h)')])} SELECT * FROM n")
def freeze_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.full_scan(spark).select("code", F.array_join(signals.context_notes(F.col("freeze_frame")), "; ").alias("notes"))
