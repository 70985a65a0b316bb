"""Bit-field decoding of frames to signals, coverage, validation and signal statistics."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from torquelake.functions import dims


def _word(bytes_: Column) -> Column:
    """The first eight bytes of an array as a big-endian 64-bit integer."""
    return F.aggregate(F.slice(bytes_, 1, 8), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 8).bitwiseOR(x.cast("long")))


def raw_value(data: Column, start: Column, length: Column, byte_order: Column, signed: Column, size: Column | None = None) -> Column:
    """The raw integer of a signal of 1 to 64 bits in a frame of any length; unsigned values of 64 bits keep their bits (see ``number``).

    Short frames count as padded with zeros to eight bytes, or to ``size``; NULL if the signal ends beyond. The nine bytes that
    can hold a signal are cut out: little-endian ones from the start bit's byte up, big-endian ones along the walk from the
    most significant bit.
    """
    is_little = byte_order == "little"
    first_bit = F.when(is_little, start).otherwise(8 * F.floor(start / 8) + (7 - start % 8)).cast("int")
    room = 8 * F.greatest(F.size(data), F.lit(8), *([F.coalesce(size, F.lit(8))] if size is not None else []))
    fits = (length >= 1) & (length <= 64) & (first_bit >= 0) & (first_bit + length <= room)
    skip = (first_bit % 8).cast("int")
    held = F.slice(F.concat(data, F.array_repeat(F.lit(0), 72)), F.when(fits, F.floor(first_bit / 8).cast("int")).otherwise(0) + 1, 9)
    ninth = F.element_at(held, 9).cast("long")
    up = lambda v, n: F.call_function("shiftleft", v, n.cast("int"))
    down = lambda v, n: F.call_function("shiftrightunsigned", v, n.cast("int"))
    zero = F.lit(0).cast("long")
    little = down(_word(F.reverse(F.slice(held, 1, 8))), skip).bitwiseOR(F.when(skip > 0, up(ninth, 64 - skip)).otherwise(zero))
    after = 72 - skip - length  # bits of the nine bytes behind the signal
    word = _word(held)
    big = F.when(after >= 8, down(word, after - 8)).otherwise(up(word, 8 - after).bitwiseOR(down(ninth, after)))
    ones = up(F.lit(-1).cast("long"), F.when(length < 64, length).otherwise(F.lit(0)))
    value = F.when(is_little, little).otherwise(big)
    masked = F.when(length == 64, value).otherwise(value.bitwiseAND(F.bitwise_not(ones)))
    top = down(masked, F.greatest(length - 1, F.lit(0))).bitwiseAND(F.lit(1).cast("long"))
    return F.when(fits, F.when(signed & (length < 64) & (top == 1), masked.bitwiseOR(ones)).otherwise(masked))


def number(raw: Column, length: Column, signed: Column) -> Column:
    """The raw integer as a double, unsigned ones of 64 bits among them."""
    return raw.cast("double") + F.when(~signed & (length == 64) & (raw < 0), F.lit(18446744073709551616.0)).otherwise(F.lit(0.0))


def decode(frames: DataFrame, dbc: DataFrame) -> DataFrame:
    """Long format: a row per frame and numeric signal; frames of unknown ids drop out.

    Definitions of a car are some thousand rows at most, so they are broadcast; values with a named
    choice are states, not numbers, and are left out. Where definitions have a ``presence`` column, a
    multiplexed signal is decoded only in frames in which every switch above it has one of its values.
    """
    ids = F.when(F.col("can_id").rlike("^[0-9A-Fa-f]+$"), F.conv("can_id", 16, 10).cast("long"))
    d = dbc.where(F.col("message").isNotNull()).withColumnRenamed("signal", "_signal")
    j = frames.withColumn("frame_id", ids).join(F.broadcast(d), "frame_id")
    size = F.col("msg_length") if "msg_length" in dbc.columns else None
    if "presence" in dbc.columns:

        def holds(c: Column) -> Column:
            state = raw_value(F.col("data"), c["start_bit"], c["length_bits"], c["byte_order"], F.lit(False), size)
            return F.coalesce(F.exists(c["ranges"], lambda r: state.between(r["low"], r["high"])), F.lit(False))

        j = j.where(F.col("presence").isNull() | F.forall("presence", holds))
    j = j.withColumn("raw", raw_value(F.col("data"), F.col("start_bit"), F.col("length_bits"), F.col("byte_order"), F.col("is_signed"), size))
    numeric = F.col("raw").isNotNull() & (F.col("choices").isNull() | ~F.coalesce(F.map_contains_key("choices", F.col("raw")), F.lit(False)))
    value = number(F.col("raw"), F.col("length_bits"), F.col("is_signed")) * F.col("scale") + F.col("offset")
    return j.where(numeric).select("frame_idx", "timestamp", "dbc", "message", "can_id", F.col("_signal").alias("signal"), value.alias("value"))


def coverage(frames: DataFrame, dbc: DataFrame) -> DataFrame:
    """Per definition file: observed, known and matched ids, and the percentage matched."""
    seen = frames.select(F.when(F.col("can_id").rlike("^[0-9A-Fa-f]+$"), F.conv("can_id", 16, 10).cast("long")).alias("frame_id")).distinct()
    known = dbc.where(F.col("message").isNotNull()).select("dbc", "frame_id").distinct()
    matched = known.join(seen, "frame_id", "left_semi").groupBy("dbc").agg(F.count("*").alias("matched"))
    total = seen.agg(F.count("*").alias("observed"))
    per = known.groupBy("dbc").agg(F.count("*").alias("known")).join(matched, "dbc", "left").join(F.broadcast(total))
    m = F.coalesce("matched", F.lit(0))
    return per.select("dbc", "observed", "known", m.alias("matched"), F.coalesce(F.bround(F.try_divide(100.0 * m, F.col("observed")), 1), F.lit(0.0)).alias("coverage_percent"))


def best_dbc(cov: DataFrame) -> DataFrame:
    """The file with the highest coverage; the first name among equals."""
    return cov.orderBy(F.desc("coverage_percent"), "dbc").limit(1)


def signal_summary(signals: DataFrame, places: int = 3) -> DataFrame:
    r = lambda c: F.bround(c, places)
    return signals.groupBy("signal").agg(F.count("*").alias("count"), r(F.min("value")).alias("min"), r(F.max("value")).alias("max"), r(F.avg("value")).alias("mean"), r(F.stddev_samp("value")).alias("std"))


def physical_validation(signals: DataFrame) -> DataFrame:
    """Signals with a known physical range: samples, share in range, OK only if all are."""
    j = signals.join(F.broadcast(dims.physical_ranges(signals.sparkSession)), "signal")
    inside = F.count_if(F.col("value").between(F.col("lo"), F.col("hi")))
    return j.groupBy("signal", "unit").agg(
        F.count("*").alias("samples"), F.bround(F.min("value"), 2).alias("min"), F.bround(F.max("value"), 2).alias("max"), F.bround(F.avg("value"), 2).alias("mean"),
        F.bround(100 * inside / F.count("*"), 1).alias("in_range_percent"), F.when(inside == F.count("*"), "OK").otherwise("CHECK").alias("status"),
    )


def signal_stats(signals: DataFrame) -> DataFrame:
    """Distribution of each signal and its latest value by frame order; std is 0 for one sample."""
    return signals.groupBy("signal").agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.max_by("value", "frame_idx").alias("latest"), F.count("*").alias("count"),
    )


def rebased(signals: DataFrame) -> DataFrame:
    """Plot data: time from each signal's first sample, by join with its minimum."""
    t0 = signals.groupBy("signal").agg(F.min("timestamp").alias("_t0"))
    return signals.join(F.broadcast(t0), "signal").withColumn("t", F.col("timestamp") - F.col("_t0")).drop("_t0")


def lookup(dbc: DataFrame, asked: DataFrame) -> DataFrame:
    """How each asked name (column ``signal``, case counts) is defined: its first definition by file, identifier and place.

    Names without a definition, null among them, have ``found`` false, an ``error`` and nulls; repeated names one row.
    """
    first = Window.partitionBy("signal").orderBy("dbc", "frame_id", "pos")
    d = dbc.where(F.col("message").isNotNull()).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    unit = F.coalesce(F.col("unit"), F.lit("")) if "unit" in dbc.columns else F.lit("")
    d = d.select(
        "signal", "message", F.hex("frame_id").alias("can_id_hex"), "start_bit", "length_bits", "byte_order", "is_signed", F.col("scale").alias("factor"), "offset", unit.alias("unit"),
        F.col("minimum").alias("declared_min"), F.col("maximum").alias("declared_max"), F.lit(True).alias("_found"),
    )
    out = asked.select("signal").distinct().join(d, "signal", "left").withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found")
    return out.withColumn("error", F.when(~F.col("found"), F.concat(F.lit("Signal '"), F.coalesce("signal", F.lit("")), F.lit("' not in DBC"))))


def implausible(signals: DataFrame, dbc: DataFrame) -> DataFrame:
    """Declared and observed ranges of each signal (its first definition), observed raw range, and a scaling hypothesis."""
    first = Window.partitionBy("signal").orderBy("dbc", "frame_id", "pos")
    d = dbc.where(F.col("message").isNotNull()).withColumn("_n", F.row_number().over(first)).where("_n = 1").select("signal", "scale", "offset", "minimum", "maximum")
    factor = F.coalesce(F.nullif(F.col("scale"), F.lit(0.0)), F.lit(1.0))
    o = signals.groupBy("signal").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean")).join(F.broadcast(d), "signal")
    guess = F.when(F.abs("offset") > 40, "large offset").when(F.coalesce(F.col("mean") < F.col("minimum"), F.lit(False)), "below declared minimum").otherwise("OK")
    return o.select("signal", F.bround("lo", 1).alias("observed_min"), F.bround("hi", 1).alias("observed_max"), F.bround((F.col("lo") - F.col("offset")) / factor, 2).alias("raw_min"), F.bround((F.col("hi") - F.col("offset")) / factor, 2).alias("raw_max"), guess.alias("hypothesis"))


def freeze_correlation(faults: DataFrame, stats: DataFrame) -> DataFrame:
    """Per fault and freeze condition with a live signal: z-score, whether inside the live range.

    ``faults``: code, freeze_frame array of (name, value, unit). The first candidate signal that exists counts.
    """
    names = [(c, s, i) for c, v in dims.FREEZE_SIGNALS.items() for i, s in enumerate(v)]
    cand = F.broadcast(stats.sparkSession.createDataFrame(names, "name string, signal string, choice int"))
    live = stats.join(cand, "signal").groupBy("name").agg(F.min_by(F.struct("signal", "mean", "std", "min", "max"), "choice").alias("s"))
    f = faults.select("code", F.explode("freeze_frame").alias("c")).select("code", "c.name", "c.value")
    inside = F.col("value").between(F.col("s.min"), F.col("s.max"))
    z = F.when(F.col("s.std") > 1e-6, F.bround((F.col("value") - F.col("s.mean")) / F.col("s.std"), 2))
    return f.where("value IS NOT NULL").join(F.broadcast(live), "name").select(
        "code", F.col("name").alias("freeze_condition"), F.col("value").alias("freeze_value"), F.col("s.signal").alias("matched_signal"), z.alias("z_score"),
        F.when(z.isNull(), "signal constant sur le log (variance nulle)").alias("z_note"), inside.alias("within_live_range"),
        F.when(inside, "coherent avec le comportement observe").otherwise("hors de la plage live observee -> condition atypique").alias("interpretation"),
    )


def context_notes(freeze_frame: Column) -> Column:
    """French notes on engine speed, vehicle speed and coolant temperature of a freeze frame, in its order."""

    def note(x: Column) -> Column:
        v = x["value"]
        rpm = F.when(v < 900, "defaut au ralenti").when(v > 2000, "defaut en charge / haut regime").otherwise("defaut en regime intermediaire")
        speed = F.when(v == 0, "vehicule a l'arret").otherwise(F.concat(F.lit("vehicule en mouvement ("), v, F.lit(" "), x["unit"], F.lit(")")))
        cool = F.when(v < 60, "moteur froid").when(v > 90, "moteur chaud")
        return F.when(v.isNotNull(), F.when(x["name"] == "engine_rpm", rpm).when(x["name"] == "vehicle_speed", speed).when(x["name"] == "coolant_temp", cool))

    return F.array_compact(F.transform(freeze_frame, note))


def extraction_counters(signals: DataFrame) -> DataFrame:
    """One row: decoded frames, different messages and signals, data points."""
    return signals.agg(F.count_distinct("frame_idx").alias("frames_decoded"), F.count_distinct("message").alias("messages"), F.count_distinct("signal").alias("signals"), F.count("*").alias("datapoints"))


def export(signals: DataFrame, folder: str) -> dict[str, str]:
    """Decoded signals as Parquet, and their summary, a row per signal by falling count, as CSV."""
    out = {"signals": f"{folder}/signals.parquet", "summary": f"{folder}/summary.csv"}
    signals.write.mode("overwrite").parquet(out["signals"])
    signal_summary(signals).orderBy(F.desc("count"), "signal").coalesce(1).write.mode("overwrite").option("header", True).csv(out["summary"])
    return out


def load_signals(spark: SparkSession, path: str) -> tuple[DataFrame | None, dict]:
    """(signals, {available, error}): a missing or unreadable file is a state, not an exception."""
    try:
        df = spark.read.parquet(path)
        if missing := {"signal", "value", "timestamp"} - set(df.columns):
            return None, {"available": False, "error": f"columns {sorted(missing)} are missing"}
        return df, {"available": True, "error": None}
    except AnalysisException as e:
        gone = "PATH_NOT_FOUND" in str(e)
        return None, {"available": False, "error": None if gone else type(e).__name__}
