"""CAN log sources: raw text lines to frame tables, and a distributed frame index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from torquelake.session import stored

RAW_COLUMNS = ["timestamp", "can_id", "dlc", *[f"d{i}" for i in range(8)], "flag"]
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])


def index_frames(df: DataFrame, *order: str, name: str = "frame_idx") -> DataFrame:
    """Number the rows 0, 1, ... in ``order`` without gathering them in one task.

    Rows are range-partitioned and sorted; each partition's count gives the next one's offset (one
    number per partition reaches the driver), and a row's number is its offset plus its place.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(spread.withColumn("_mono", F.monotonically_increasing_id()), "frames")  # numbers must not change if an executor is lost
    part = F.shiftright("_mono", 33)
    counts = sorted(tuple(r) for r in placed.groupBy(part.alias("p")).count().collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    table = df.sparkSession.createDataFrame(offsets, "_p long, _offset long")
    local = F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(table), part == F.col("_p")).withColumn(name, F.col("_offset") + local).drop("_mono", "_p", "_offset")


def hex_int(c: Column) -> Column:
    """Unsigned value of a hex field; NULL if it is not hex."""
    return F.when(c.rlike("^[0-9A-Fa-f]+$"), F.conv(c, 16, 10).cast("int"))


def parse_variable(lines: DataFrame, value: str = "value") -> DataFrame:
    """``timestamp,id,dlc,<dlc bytes>,flag`` lines to (timestamp, can_id, dlc, data[8], label); lines of under four fields go."""
    p = F.split(F.trim(F.col(value)), ",")
    out = lines.withColumn("_p", p).where(F.size("_p") >= 4)
    dlc = F.get("_p", F.lit(2)).try_cast("int")
    given = F.transform(F.slice("_p", 4, F.greatest(F.least(dlc, F.size("_p") - 4), F.lit(0))), lambda b: F.coalesce(hex_int(b), F.lit(0)))
    data = F.slice(F.concat(given, F.array_repeat(F.lit(0), 8)), 1, 8)
    return out.select(
        *[c for c in lines.columns if c != value],
        F.get("_p", F.lit(0)).try_cast("double").alias("timestamp"), F.upper(F.get("_p", F.lit(1))).alias("can_id"), dlc.alias("dlc"), data.alias("data"),
        (F.element_at("_p", -1) == "T").cast("int").alias("label"),
    )


def read_variable(spark: SparkSession, path: str, nrows: int | None = None) -> DataFrame:
    """The variable-length reading of a log; with ``nrows`` the first rows, numbered in ``frame_idx`` as they stand in the file."""
    lines = spark.read.text(path)
    if nrows is None:
        return parse_variable(lines)
    rows = parse_variable(lines.withColumn("_line", F.monotonically_increasing_id()))
    return index_frames(rows, "_line").where(F.col("frame_idx") < nrows).drop("_line")


def parse_fixed(lines: DataFrame, value: str = "value") -> DataFrame:
    """Twelve fixed fields of a line; missing ones are empty strings, so a short frame has no flag."""
    p = F.split(F.col(value), ",")
    field = lambda i: F.coalesce(F.get(p, F.lit(i)), F.lit(""))
    cols = {c: field(i) for i, c in enumerate(RAW_COLUMNS)}
    cols |= {"timestamp": field(0).try_cast("double"), "dlc": field(2).try_cast("int"), "can_id": F.upper(field(1))}
    return lines.select(*[c for c in lines.columns if c != value], *[v.alias(k) for k, v in cols.items()])


def read_fixed(spark: SparkSession, path: str, nrows: int | None = None) -> DataFrame:
    """The fixed-width reading of a log; ``nrows`` keeps the first rows by index."""
    rows = parse_fixed(spark.read.text(path).withColumn("_line", F.monotonically_increasing_id()))
    if nrows is None:
        return rows.drop("_line")
    return index_frames(rows, "_line").where(F.col("frame_idx") < nrows).drop("_line", "frame_idx")


def payload_bytes(dlc: Column, fields: list[Column]) -> Column:
    """The first ``dlc`` byte fields as integers; an empty field is 0."""
    return F.transform(F.slice(F.array(*fields), 1, F.greatest(F.least(dlc, F.lit(8)), F.lit(0))), lambda b: F.coalesce(hex_int(b), F.lit(0)))


def filter_normal(df: DataFrame) -> DataFrame:
    return df.where(F.col("flag") == "R")


def filter_attack(df: DataFrame) -> DataFrame:
    return df.where(F.col("flag") == "T")
