"""Signal definition files (BO_ / SG_ lines) as a dimension table: a Python data source, ``spark.read.format("dbc")``, and a reader of any store Spark reads."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

SCHEMA = (
    "dbc string, load_mode string, error string, message string, frame_id long, msg_length int, signal string, pos int, start_bit int, length_bits int, "
    "byte_order string, is_signed boolean, scale double, offset double, unit string, minimum double, maximum double, choices map<long,string>, mux string, "
    "presence array<struct<start_bit: int, length_bits: int, byte_order: string, ranges: array<struct<low: long, high: long>>>>"
)
_BO = re.compile(r"^BO_\s+(\d+)\s+(\w+)\s*:\s*(\d+)\s+(\w+)")
_SG = re.compile(r'^\s*SG_\s+(?P<name>\w+)(?:\s+(?P<mux>M|m\d+M?))?\s*:\s*(?P<start>\d+)\|(?P<length>\d+)@(?P<order>[01])(?P<sign>[+-])\s*\((?P<scale>[^,]+),(?P<offset>[^)]+)\)\s*\[(?P<lo>[^|]*)\|(?P<hi>[^\]]*)\]\s*"(?P<unit>[^"]*)"')
_MUL = re.compile(r"^SG_MUL_VAL_\s+(\d+)\s+(\w+)\s+(\w+)\s+(.*);")
_VAL = re.compile(r"^VAL_\s+(\d+)\s+(\w+)\s+(.*);")


def _presence(signals: dict[str, tuple], above: dict[str, tuple[str, list]], name: str) -> list | None:
    """The switches above a signal, from the message's own down, each with the values at which it is there; None for a signal that is always there.

    ``signals``: name to (start_bit, length_bits, byte_order); ``above``: name to (switch, ranges). Raises ValueError on a loop or a missing switch.
    """
    chain, seen = [], {name}
    while name in above:
        name, ranges = above[name]
        if name in seen or name not in signals:
            raise ValueError(f"no way from a switch to {name}")
        seen.add(name)
        chain.append((*signals[name], ranges))
    return chain[::-1] or None


def parse(name: str, text: str) -> list[tuple]:
    """Rows of one file. A malformed line is skipped and the file marked "permissive"; a file without messages carries an error row.

    ``mux`` is the multiplexer mark: "M" for a message's switch, "m3" for a signal that is present when the switch is 3, "m3M" for
    one that is a switch itself. ``presence`` resolves the marks, and SG_MUL_VAL_ lines where switches are nested or have ranges.
    """
    rows, mode, message, choices, pos = [], "strict", None, {}, 0
    given: dict[tuple[int, str], tuple[str, list]] = {}
    for line in text.splitlines():
        if m := _VAL.match(line):
            choices[int(m[1]) & 0x1FFFFFFF, m[2]] = {int(k): v for k, v in re.findall(r'(-?\d+)\s+"([^"]*)"', m[3])}
        elif m := _MUL.match(line):
            given[int(m[1]) & 0x1FFFFFFF, m[2]] = (m[3], [(int(a), int(b)) for a, b in re.findall(r"(\d+)\s*-\s*(\d+)", m[4])])
    for line in text.splitlines():
        if m := _BO.match(line):
            message, pos = (m[2], int(m[1]) & 0x1FFFFFFF, int(m[3])), 0
        elif line.lstrip().startswith("SG_"):
            m = _SG.match(line)
            if not m or not message:
                mode = "permissive" if not line.startswith("SG_MUL_VAL_") else mode
                continue
            try:
                lo, hi = float(m["lo"] or 0), float(m["hi"] or 0)
                bounds = (None, None) if lo == hi == 0 else (lo, hi)
                rows.append((*message, m["name"], pos, int(m["start"]), int(m["length"]), "little" if m["order"] == "1" else "big", m["sign"] == "-", float(m["scale"]), float(m["offset"]), m["unit"], *bounds, choices.get((message[1], m["name"])), m["mux"]))
                pos += 1
            except ValueError:
                mode = "permissive"
        elif line.startswith("BO_ "):
            mode = "permissive"
    if not rows:
        return [(name, "failed", "no message definition found", *[None] * 17)]
    by_id: dict[int, dict[str, tuple]] = {}
    main: dict[int, str] = {}
    for r in rows:
        by_id.setdefault(r[1], {})[r[3]] = (r[5], r[6], r[7])
        if r[15] == "M":
            main.setdefault(r[1], r[3])
    above: dict[int, dict[str, tuple[str, list]]] = {k: {} for k in by_id}
    for r in rows:
        if (own := given.get((r[1], r[3]))) and own[1]:
            above[r[1]][r[3]] = own
        elif r[15] and r[15] != "M":
            value = int(r[15].strip("mM"))
            above[r[1]][r[3]] = (main.get(r[1], ""), [(value, value)])
    out = []
    for r in rows:
        try:
            out.append((*r, _presence(by_id[r[1]], above[r[1]], r[3])))
        except ValueError:  # a signal whose switch is unknown is never known to be there
            mode = "permissive"
    return [(name, mode, None, *r) for r in out] or [(name, "failed", "no message definition found", *[None] * 17)]


class DbcSource(DataSource):
    """``spark.read.format("dbc").option("glob", "*.dbc").load(folder)``: a partition for each file.

    Filters on ``frame_id`` (=, IN) and ``dbc`` (=) are applied while reading (spark.sql.python.filterPushdown.enabled); one on
    ``dbc`` leaves other files unread. Paths are those that pyarrow opens (local, hdfs, s3 ...); ``read_dbc`` takes all others.
    """

    @classmethod
    def name(cls) -> str:
        return "dbc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return DbcReader(self.options)


class DbcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.glob = options.get("path", ""), options.get("glob", "*.dbc")
        self.ids: set[int] | None = None
        self.files: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("frame_id",):
                self.ids = values if self.ids is None else self.ids & values
            elif values is not None and f.attribute == ("dbc",):
                self.files = values if self.files is None else self.files & values
            else:
                yield f

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if re.match(r"\w+:", self.path) else os.path.abspath(self.path))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = self._store()
        found = store.get_file_info(fs.FileSelector(root)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
        names = sorted(i.path for i in found if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, self.glob) and (self.files is None or i.base_name in self.files))
        return [InputPartition(n) for n in names]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None or partition.value is None:
            return
        store, _ = self._store()
        with store.open_input_stream(partition.value) as f:
            text = f.read().decode("iso-8859-1")
        for r in parse(partition.value.rsplit("/", 1)[-1], text):
            if self.ids is None or r[4] in self.ids:
                yield r


def signals_function(schema: T.StructType) -> type:
    """The class behind the SQL function ``dbc_signals(path [, glob])``: the definitions of a file or folder as a table.

    ``SELECT * FROM files, LATERAL dbc_signals(files.path)`` reads many files in parallel.
    """

    class DbcSignals:  # a local class travels to the workers with its schema
        @staticmethod
        def analyze(path: AnalyzeArgument, glob: AnalyzeArgument | None = None) -> AnalyzeResult:
            for a in (path, glob):
                if a is not None and not isinstance(a.dataType, T.StringType):
                    raise ValueError(f"dbc_signals takes strings, not {a.dataType.simpleString()}")
            return AnalyzeResult(schema)

        def eval(self, path: str | None, glob: str = "*.dbc") -> Iterator[tuple]:
            if path is not None:
                reader = DbcReader({"path": path, "glob": glob})
                for part in reader.partitions():
                    yield from reader.read(part)

    return DbcSignals


def register(spark: SparkSession) -> None:
    """Make ``format("dbc")``, with filters pushed down, and ``dbc_signals`` known to a session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DbcSource)
    spark.udtf.register("dbc_signals", F.udtf(signals_function(spark.createDataFrame([], SCHEMA).schema)))


def read_dbc(spark: SparkSession, path: str, glob: str = "*.dbc") -> DataFrame:
    """All definition files under ``path``, in any store that Spark reads, that match ``glob``; one file is one row of a task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.decode("content", "ISO-8859-1").alias("text"))
    columns = [c.strip().split(" ")[0] for c in re.sub(r"<.*?>+", "", SCHEMA).split(",")]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            made = [r for n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in parse(n, t)]
            switch = ("start_bit", "length_bits", "byte_order", "ranges")
            dicts = [dict(zip(columns, r, strict=True)) for r in made]
            for d in dicts:
                d["choices"] = None if d["choices"] is None else list(d["choices"].items())
                d["presence"] = None if d["presence"] is None else [dict(zip(switch, (*c[:3], [{"low": x, "high": y} for x, y in c[3]]), strict=True)) for c in d["presence"]]
            yield pa.RecordBatch.from_pylist(dicts, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark.createDataFrame([], SCHEMA).schema)
    return files.mapInArrow(run, SCHEMA)


def file_info(dbc: DataFrame) -> DataFrame:
    """One row per file: loaded, mode, messages, error."""
    return dbc.groupBy("dbc").agg(F.max(F.col("message").isNotNull()).alias("loaded"), F.max("load_mode").alias("load_mode"), F.count_distinct("frame_id").alias("n_messages"), F.max("error").alias("error"))


def list_messages(dbc: DataFrame) -> DataFrame:
    """Messages with their hex id and signals in order."""
    g = dbc.where(F.col("message").isNotNull()).groupBy("dbc", "message", "frame_id")
    return g.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "signal"))), lambda x: x["signal"]).alias("signals")).withColumn("hex_id", F.hex("frame_id"))


def find_signal(dbc: DataFrame, keyword: str) -> DataFrame:
    """Signals whose name contains ``keyword``, ignoring case."""
    return dbc.where(F.lower("signal").contains(keyword.lower()))
