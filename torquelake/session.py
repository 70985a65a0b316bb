"""Session settings the engine is written for, and the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def build_session(app: str = "torquelake", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; in a folder of this machine if that is unset and Spark runs on it alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = _own.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='torquelake-')}")
    return f"{root.rstrip('/')}/torquelake-{name}-{uuid.uuid4().hex}"


#: Options of a writer for rows of megabytes: few of them are held at once, in writing and in reading.
BIG_ROWS = {"parquet.block.size": str(32 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def stored(df, name: str, **options: str):
    """``df`` written to the shared folder and read back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    schema = df.schema
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
