"""Shared plumbing of the training-data operators: tables, shared storage, word rules."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"

_made: dict[str, SparkSession] = {}
_shipped: set[str] = set()
_own_dirs: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, so that a batch of very long texts stays within a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    ship(spark)


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, unless they find it on PYTHONPATH."""
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    archive = Path(tempfile.mkdtemp(prefix="torquelake-")) / "torquelake_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "torquelake").rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(str(archive))


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share (spark.checkpoint.dir). One of this machine's own serves where none is set, and only if Spark runs on it alone."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return _own_dirs.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='torquelake-')}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/torquelake-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    if not _made:
        atexit.register(_sweep)
    _made[path] = spark
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more, and let Spark drop the shuffles they came from."""
    for t in tables:
        _delete(t.sparkSession, t.stored_at)
        _made.pop(t.stored_at, None)
    release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffles of plans that have run: it removes the files of collected plans."""
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def scratch(keep: Callable[[], list[DataFrame]] = list) -> Iterator[None]:
    """Tables written inside go at the end, all but those that ``keep`` names then. Only for results that were written."""
    before = set(_made)
    yield
    kept = {t.stored_at for t in keep()}
    for path in [p for p in _made if p not in before and p not in kept]:
        _delete(_made.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop.Path(path), True)


def _sweep() -> None:
    for path, spark in _made.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - at exit the JVM may be gone; the folder is the cluster's to clean
            return


def let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once: a lambda over a one-element array names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a non-null text, in order."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus
