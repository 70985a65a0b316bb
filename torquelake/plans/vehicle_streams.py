"""Queries on streams: each table is fed in slices to a stream that restarts from its checkpoint for every slice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from torquelake.operators import protocol
from torquelake.plans.proxy import raw_frames, table
from torquelake.streaming import bus as stream_bus
from torquelake.streaming import stateful

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("streaming_bus_counts", "SELECT epoch_us(time_bucket(INTERVAL 10 MINUTE, ts)) AS start_us, printf('%X', user_id) AS can_id, count(*) AS n_frames FROM events GROUP BY ALL")
def streaming_bus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    raw = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet*").parquet(sf_dir)
    s = raw.select(F.col("ts").cast("timestamp").alias("ts"), F.hex("user_id").alias("can_id"))
    out = stream_bus.latest_counts(stream_bus.windowed_counts(s), ["start", "can_id"])
    return out.select(F.unix_micros("start").alias("start_us"), "can_id", "n_frames")


# One unit per conversation, one message per turn. Of one message in seven the second frame is lost.
_LOST = "(conv_id * 1000 + turn) % 7 = 3"


def _unit_frames(spark: SparkSession, sf_dir: str, low: int, high: int) -> DataFrame:
    """The frames at places from ``low`` to below ``high``; only texts of their turns are encoded."""
    turns = table(spark, sf_dir, "conversations").where(F.col("turn").between(low // 10_000, (high - 1) // 10_000))
    c = turns.select("conv_id", "turn", F.posexplode(protocol.encode_frames(F.hex(F.encode("text", "UTF-8")))).alias("idx", "frame"))
    f = c.where(f"NOT ({_LOST} AND idx = 1)").select(F.col("conv_id").alias("unit"), (F.col("turn") * 10_000 + F.col("idx")).alias("place"), "frame")
    return f.where((F.col("place") >= low) & (F.col("place") < high))


@query("streaming_reassemble", f"""WITH p AS (SELECT conv_id, turn, hex(encode("text")) AS h, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS message FROM conversations WHERE octet_length(encode("text")) <= 4095),
  f AS (SELECT *, {_LOST} AND length(h) // 2 > 7 AS lost, CASE WHEN length(h) // 2 <= 13 THEN 'incomplete' ELSE 'bad sequence' END AS e FROM p)
  SELECT conv_id AS unit, message, CASE WHEN NOT lost THEN h END AS payload, CASE WHEN lost THEN e END AS error FROM f""")
def streaming_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = [0, 10_004, 30_009, 1 << 40]  # within messages
    slices = [_unit_frames(spark, sf_dir, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
    wake = spark.createDataFrame([(-1, 0, protocol.flow_control())], slices[0].schema)  # the clock of abandoned messages runs in any micro-batch
    return stream_bus.run_slices([*slices, wake], lambda s: stateful.reassemble(s, "unit", "place", wait_ms=1))


_BUS_SQL = """f AS (SELECT user_id % 8 AS bus, event_id, epoch_us(ts) / 1e6 AS "timestamp", user_id, CASE WHEN event_type = 'error' AND value > 40 THEN 1 ELSE 0 END AS label,
  row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) - 1 AS i FROM events)"""


#: Frames of a slice at most, so that the rows a Python worker holds at once do not grow with the table.
SLICE_ROWS = 500_000


def _bus_slices(spark: SparkSession, sf_dir: str, n: int = 3) -> list[DataFrame]:
    """Slices in order of event_id, ``n`` of them or as many as hold about ``SLICE_ROWS`` each; cut between ranges of event_id, which are counted."""
    f = raw_frames(spark, sf_dir).withColumn("bus", F.col("user_id") % 8).select("bus", "event_id", "timestamp", "can_id", "label")
    low, high, rows = f.agg(F.min("event_id"), F.max("event_id"), F.count("*")).first()
    n = max(n, -(-rows // SLICE_ROWS))
    low, high = low or 0, (high or 0) + 1
    step = -(-(high - low) // (64 * n))  # 64 ranges a slice
    held = f.groupBy(F.floor((F.col("event_id") - low) / step).alias("k")).agg(F.count("*").alias("c")).where("k IS NOT NULL").orderBy("k").collect()
    cuts, size = [low], 0
    for k, c in held:
        if size and size + c > -(-rows // n):
            cuts.append(low + k * step)
            size = 0
        size += c
    cuts.append(high)
    return [f.where((F.col("event_id") >= a) & (F.col("event_id") < b)) for a, b in zip(cuts, cuts[1:], strict=False)]


@query("streaming_windows", f"""WITH {_BUS_SQL}, n AS (SELECT bus, count(*) AS n FROM f GROUP BY bus), w AS (SELECT f.*, i // 32 - j AS window_id FROM f, (VALUES (0), (1)) v(j))
  SELECT bus, window_id, count(*) AS n_frames, CAST(sum(label) AS BIGINT) AS attacks, min(event_id) AS first_event, max(event_id) AS last_event, max(i - window_id * 32) AS last_pos
  FROM w JOIN n USING (bus) WHERE window_id >= 0 AND window_id * 32 + 64 <= n GROUP BY ALL""")
def streaming_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stream_bus.run_slices(_bus_slices(spark, sf_dir), lambda s: stateful.count_windows(s, "bus", "event_id"))
    return out.groupBy("bus", "window_id").agg(
        F.count("*").alias("n_frames"), F.sum("label").alias("attacks"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.max("pos").alias("last_pos")
    )


@query("streaming_features", f"""WITH {_BUS_SQL} SELECT bus, event_id, i AS frame_idx, round(ln(1 + greatest(coalesce("timestamp" - lag("timestamp") OVER (PARTITION BY bus ORDER BY i), 0), 0)), 6) AS inter_arrival,
  count(*) OVER (PARTITION BY bus, user_id ORDER BY i RANGE BETWEEN 199 PRECEDING AND CURRENT ROW) / least(i + 1, 200)::DOUBLE AS id_freq FROM f""")
def streaming_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stream_bus.run_slices(_bus_slices(spark, sf_dir), lambda s: stateful.rolling_features(s, "bus", "event_id", window=200))
    return out.select("bus", "event_id", "frame_idx", F.round("inter_arrival", 6).alias("inter_arrival"), "id_freq")
