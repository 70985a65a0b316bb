"""Vehicle identification numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torquelake.functions import dims


def normal(vin: Column) -> Column:
    return F.upper(F.trim(vin))


def is_valid(vin: Column) -> Column:
    return F.coalesce(normal(vin).rlike("^[A-HJ-NPR-Z0-9]{17}$"), F.lit(False))


def with_manufacturer(df: DataFrame, vin: str = "vin") -> DataFrame:
    """Longest-prefix join: three characters, then two, as two equi-joins with a table of some twenty rows."""
    wmi = dims.manufacturers(df.sparkSession)
    v = normal(F.col(vin))
    three = F.broadcast(wmi.select(F.col("wmi").alias("_w3"), F.struct("manufacturer", "country").alias("_m3")))
    two = F.broadcast(wmi.select(F.col("wmi").alias("_w2"), F.struct("manufacturer", "country").alias("_m2")))
    out = df.join(three, F.substring(v, 1, 3) == F.col("_w3"), "left").join(two, F.substring(v, 1, 2) == F.col("_w2"), "left")
    m = F.coalesce("_m3", "_m2")
    return out.withColumns({"manufacturer": F.coalesce(m["manufacturer"], F.lit("Unknown")), "country": F.coalesce(m["country"], F.lit("Unknown"))}).drop("_w3", "_m3", "_w2", "_m2")


def model_year(vin: Column) -> Column:
    return dims.lookup(dims.YEARS, F.substring(normal(vin), 10, 1)).cast("int")


def merge_enrichment(local: Column, remote: Column) -> Column:
    """An enrichment value replaces the local one unless it is missing or "Unknown"."""
    return F.coalesce(F.nullif(remote, F.lit("Unknown")), local)


def decode(df: DataFrame, vin: str = "vin") -> DataFrame:
    """valid, wmi, manufacturer, country, year; NULLs for an invalid number."""
    ok = is_valid(F.col(vin))
    out = with_manufacturer(df.withColumn("valid", ok), vin)
    only = lambda c: F.when(F.col("valid"), c)
    return out.withColumns({"wmi": only(F.substring(normal(F.col(vin)), 1, 3)), "manufacturer": only(F.col("manufacturer")), "country": only(F.col("country")), "year": only(model_year(F.col(vin)))})
