"""Sharding by sampled splitters, law ``bytes``: shards of nearly equal size.

1. A size-weighted sample of keys is drawn (exponential priorities, so a row's chance grows with its
   size); the key is a hash of the text, so equal texts share a key.
2. Quantiles of the sample split the key space into fine ranges; keys drawn again and again
   (large groups of equal texts) become units of their own.
3. Exact bytes of every unit are counted. A range that holds over ``OVERFULL`` times its share is
   subdivided by a second hash of the key, a large group by doc_id, both into as many parts as they hold
   shares; the parts are counted again.
4. Consecutive ranges are dealt to shards up to equal bytes, large groups first.
5. A row's slot is its unit's offset in the shard plus its row number within the unit, so no task
   ever sorts a whole shard.

Equal texts stay in one shard unless their group is larger than a shard. Only (doc_id, size, crc,
key) moves; texts are read once.

Defined results: a null text has size 1 and the checksum of no bytes; repeated rows are all placed;
an empty table gives an empty result; a null doc_id is placed like any other row; texts of any length count
whole; other columns are ignored.
"""

from __future__ import annotations

import bisect
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from torquelake.llm.common import materialize, text_or_empty

#: Fine ranges at least, and rows for each range beyond; sampled keys for each range.
MIN_RANGES, ROWS_PER_RANGE, MAX_RANGES, KEYS_PER_RANGE = 1024, 250_000, 16_384, 16
#: A key drawn so often is a large group. A range is overfull beyond so many times the bytes of an equal share.
HEAVY_DRAWS, OVERFULL = 48, 2


def _sample(rows: DataFrame, n: int) -> list[int]:
    """``n`` keys, each row drawn with a chance that grows with its size."""
    u = (F.pmod(F.xxhash64("doc_id", "key", F.lit(7)), F.lit(1 << 52)) + 1) / float(1 << 52)
    drawn = rows.select("key", (-F.log(u) / F.col("size")).alias("p")).orderBy("p", "key").limit(n)
    return sorted(r.key for r in drawn.collect())  # bounded by n


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most ``key``: first among every ``step``-th, then between two of them."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    literal = lambda values: F.array(*[F.lit(v) for v in values])
    coarse = F.size(F.filter(literal(bounds[step - 1 :: step]), lambda b: b <= key)) * step
    return coarse + F.size(F.filter(F.slice(literal(bounds), coarse + 1, F.lit(step)), lambda b: b <= key))


def _deal(units: list[tuple[int, int, int, int]], n_shards: int, heavy_from: int) -> list[tuple[int, int, int, int]]:
    """(unit, part, bytes, rows) -> (unit, part, shard, offset)."""
    total = sum(u[2] for u in units)
    target = total / n_shards
    load, count, out = [0] * n_shards, [0] * n_shards, []

    def put(u: tuple, s: int) -> None:
        out.append((u[0], u[1], s, count[s]))
        load[s] += u[2]
        count[s] += u[3]

    groups: dict[int, list] = {}
    for u in units:
        if u[0] >= heavy_from:
            groups.setdefault(u[0], []).append(u)
    for parts in sorted(groups.values(), key=lambda p: (-sum(u[2] for u in p), p[0][0])):
        whole = sum(u[2] for u in parts) <= target
        least = load.index(min(load))
        for u in parts:
            put(u, least if whole else load.index(min(load)))
    s = 0
    for u in sorted(u for u in units if u[0] < heavy_from):
        while s < n_shards - 1 and load[s] + u[2] / 2 > target:
            s += 1
        put(u, s)
    return out


def _parts(rows: DataFrame, ranges: int, heavy_from: int) -> list[tuple[int, int]]:
    """(unit, parts) of the overfull ranges and of the large groups with more than a range's share of the bytes."""
    sizes = rows.groupBy("unit").agg(F.sum("size").alias("size")).collect()  # one row a range or large group
    share = max(1, sum(r["size"] for r in sizes) // ranges)
    return [(r.unit, -(-r["size"] // share)) for r in sizes if r["size"] > share * (1 if r.unit >= heavy_from else OVERFULL)]


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` with its shard and slot: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    t = text_or_empty(text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t).cast("long") + 1).alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("key"))
    rows = materialize(rows, "shard-keys")
    n = rows.count()
    ranges = min(MAX_RANGES, max(MIN_RANGES, n // ROWS_PER_RANGE))
    keys = _sample(rows, ranges * KEYS_PER_RANGE)
    heavy = [k for k in dict.fromkeys(keys) if bisect.bisect_right(keys, k) - bisect.bisect_left(keys, k) >= HEAVY_DRAWS]
    light = [k for k in keys if k not in set(heavy)]
    bounds = sorted({light[i * len(light) // ranges] for i in range(1, ranges)}) if light else []
    spark = docs.sparkSession
    table = spark.createDataFrame([(k, i) for i, k in enumerate(heavy)], "key long, heavy int")
    mine = rows.join(F.broadcast(table), "key", "left")  # at most ranges * KEYS_PER_RANGE / HEAVY_DRAWS rows
    first = len(bounds) + 1
    mine = mine.withColumn("unit", F.when(F.col("heavy").isNotNull(), F.col("heavy") + first).otherwise(_range_of(F.col("key"), bounds)))
    parts = spark.createDataFrame(_parts(mine, ranges, first), "unit int, parts int")
    # Equal texts of a range share a part; those of a large group are told apart by doc_id.
    of_group = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("parts"))
    of_range = F.pmod(F.xxhash64("key", F.lit(5)), F.col("parts"))
    mine = mine.join(F.broadcast(parts), "unit", "left")  # overfull units only, so fewer than ranges
    mine = mine.withColumn("part", F.coalesce(F.when(F.col("heavy").isNotNull(), of_group).otherwise(of_range), F.lit(0)).cast("int"))
    units = [tuple(r) for r in mine.groupBy("unit", "part").agg(F.sum("size"), F.count("*")).collect()]  # bounded by the ranges and their parts
    plan = spark.createDataFrame(_deal(units, n_shards, first), T.StructType([T.StructField(c, T.IntegerType() if c != "offset" else T.LongType()) for c in ("unit", "part", "shard", "offset")]))
    within = F.row_number().over(Window.partitionBy("unit", "part").orderBy("key", "doc_id")) - 1
    return (
        mine.withColumn("_n", within)
        .join(F.broadcast(plan), ["unit", "part"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("offset") + F.col("_n")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
