"""Exact order statistics of groups of any size, without a sort of a group in one task.

Selection by repeated range counts. For each wanted rank an interval of values is known that holds it, at first all
values of its group. A pass cuts the interval into ``FAN`` equal ranges and counts the values of each (partial sums in
every task, then at most ``FAN`` rows a rank); the range with the rank, narrowed to the values that occur in it, is
the next interval. Intervals of one value are answered; those of at most ``FEW`` values are put in order at last. So
tasks hold ranges and not values, and values that occur often cost no more than others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from torquelake.session import stored

FAN, FEW = 4096, 10_000


def _values(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    v = F.col(column).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).select(F.struct(*([F.col(c) for c in by] or [F.lit(0)])).alias("_g"), v.alias("_v"))


def _select(values: DataFrame, wanted: DataFrame, few: int, fan: int) -> DataFrame:
    """(_g, rank, value) of the ``wanted`` (_g, rank), ranks from 0 within each group."""
    whole = values.groupBy("_g").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("*").alias("n"))
    state = stored(wanted.join(whole, "_g").where((F.col("rank") >= 0) & (F.col("rank") < F.col("n"))).withColumn("below", F.lit(0).cast("long")), "ranks")
    open_ = (F.col("n") > few) & (F.col("lo") < F.col("hi"))
    done = []
    while not (wide := state.where(open_)).isEmpty():
        done.append(state.where(~open_))
        # Halved, so that no difference overflows; each step is monotone, so ranges are in the order of their values.
        at = F.floor((F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * fan)
        inside = values.join(wide, "_g").where(F.col("_v").between(F.col("lo"), F.col("hi")))
        parts = inside.groupBy("_g", "rank", "below", F.least(at, F.lit(fan - 1)).alias("part")).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("_g", "rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = parts.withColumn("below", F.col("below") + before).where((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("n")))
        state = stored(parts.select("_g", "rank", "lo", "hi", "n", "below"), "ranks")
    for s in done:
        state = state.unionByName(s)
    one = state.where("lo = hi").select("_g", "rank", F.col("lo").alias("value"))
    rest = values.join(state.where("lo < hi"), "_g").where(F.col("_v").between(F.col("lo"), F.col("hi")))
    place = F.row_number().over(Window.partitionBy("_g", "rank").orderBy("_v")) - 1 + F.col("below")  # at most ``few`` rows
    return one.unionByName(rest.withColumn("_at", place).where("_at = rank").select("_g", "rank", F.col("_v").alias("value")))


def at_ranks(df: DataFrame, column: str, wanted: DataFrame, by: list[str], few: int = FEW, fan: int = FAN) -> DataFrame:
    """(``by``, rank, value): the values at the ranks (from 0) of ``wanted`` (``by``, rank) within each group, null and NaN left out.

    Values are finite; ranks beyond a group give no row.
    """
    found = _select(_values(df, column, by), wanted.select(F.struct(*by).alias("_g"), F.col("rank").cast("long").alias("rank")).distinct(), few, fan)
    return found.select(*[F.col("_g")[c].alias(c) for c in by], "rank", "value")


def exact(df: DataFrame, column: str, quantiles: dict[str, float], by: list[str] | None = None, few: int = FEW, fan: int = FAN) -> DataFrame:
    """``by`` and one column for each named quantile (0 to 1), linearly interpolated at q (n - 1); without ``by`` one row, NULL without values."""
    by = by or []
    values = _values(df, column, by)
    sizes = values.groupBy("_g").agg(F.count("*").alias("n"))
    places = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(q)).alias("q")) for k, q in quantiles.items()])
    at = sizes.select("_g", F.inline(F.transform(places, lambda p: F.struct(p["name"].alias("name"), (p["q"] * (F.col("n") - 1)).alias("at")))))
    at = at.withColumns({"low": F.floor("at"), "high": F.ceil("at")})
    ranks = at.select("_g", F.explode(F.array("low", "high")).alias("rank")).distinct()
    found = _select(values, ranks, few, fan)
    pick = lambda side: at.join(found.select("_g", F.col("rank").alias(side), F.col("value").alias(f"v_{side}")), ["_g", side])
    both = pick("low").join(pick("high").select("_g", "name", "v_high"), ["_g", "name"])
    value = F.when(F.col("low") == F.col("high"), F.col("v_low")).otherwise((F.col("high") - F.col("at")) * F.col("v_low") + (F.col("at") - F.col("low")) * F.col("v_high"))
    named = [F.max(F.when(F.col("name") == k, F.col("_q"))).alias(k) for k in quantiles]
    both = both.withColumn("_q", value)
    if not by:
        return both.agg(*named)
    return both.groupBy("_g").agg(*named).select(*[F.col("_g")[c].alias(c) for c in by], *quantiles)
