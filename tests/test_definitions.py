"""Definition files as a data source, nested switches, and bit fields in frames of any length, bit by bit."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from torquelake.operators import signals
from torquelake.sources import dbc

NESTED = """BO_ 790 MX: 16 ECU
 SG_ S M : 0|4@1+ (1,0) [0|15] "" X
 SG_ A m0 : 8|8@1+ (1,0) [0|255] "" X
 SG_ T m1M : 8|8@1+ (1,0) [0|255] "" X
 SG_ B m2 : 16|8@1+ (1,0) [0|255] "" X
 SG_ D m9 : 16|8@1+ (1,0) [0|255] "" X
 SG_ E : 100|28@1+ (1,0) [0|0] "" X
 SG_ Z m1 : 24|8@1+ (1,0) [0|255] "" X

BO_ 1200 OTHER: 8 ECU
 SG_ V : 7|8@0- (1,0) [0|255] "" X
SG_MUL_VAL_ 790 T S 1-1;
SG_MUL_VAL_ 790 B T 2-2, 5-7;
SG_MUL_VAL_ 790 D NOWHERE 9-9;
"""


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("defs")
    (at / "one.dbc").write_text(NESTED)
    (at / "two.dbc").write_text('BO_ 5 P: 8 X\n SG_ N : 0|8@1+ (1,0) [0|1] "" X\n')
    (at / "bad.dbc").write_text("nothing here")
    (at / "notes.txt").write_text("BO_ 9 P: 8 X")
    dbc.register(spark)
    return str(at)


def test_format_dbc_is_what_the_reader_gives(spark, folder):
    own, other = spark.read.format("dbc").load(folder), dbc.read_dbc(spark, folder)
    rows = lambda d: sorted(map(str, d.withColumn("choices", F.map_entries("choices")).collect()))
    assert rows(own) == rows(other) and own.count() == 9
    assert {r.dbc: r.loaded for r in dbc.file_info(own).collect()} == {"one.dbc": True, "two.dbc": True, "bad.dbc": False}


def test_filters_reach_the_files(spark, folder):
    d = spark.read.format("dbc").load(folder)
    assert {r.signal for r in d.where("frame_id = 1200").collect()} == {"V"}
    assert {r.signal for r in d.where("frame_id IN (1200, 5) AND signal <> 'V'").collect()} == {"N"}
    assert {r.signal for r in d.where("dbc = 'two.dbc'").collect()} == {"N"}
    reader = dbc.DbcReader({"path": folder})
    left = list(reader.pushFilters([dbc.EqualTo(("frame_id",), 5), dbc.EqualTo(("dbc",), "two.dbc"), dbc.EqualTo(("signal",), "N")]))
    assert [f.attribute for f in left] == [("signal",)]
    assert [p.value.rsplit("/", 1)[1] for p in reader.partitions()] == ["two.dbc"]


def test_sql_function(spark, folder):
    got = spark.sql(f"SELECT dbc, signal FROM dbc_signals('{folder}') WHERE frame_id = 1200").collect()
    assert [tuple(r) for r in got] == [("one.dbc", "V")]
    spark.createDataFrame([(f"{folder}/one.dbc",), (f"{folder}/two.dbc",), (None,)], "path string").createOrReplaceTempView("files")
    each = spark.sql("SELECT dbc, count(*) AS n FROM files, LATERAL dbc_signals(files.path) GROUP BY dbc").collect()
    assert {r.dbc: r.n for r in each} == {"one.dbc": 7, "two.dbc": 1}
    with pytest.raises(Exception, match="takes strings"):
        spark.sql("SELECT * FROM dbc_signals(7)").collect()


def test_nested_switches(spark, folder):
    d = spark.read.format("dbc").load(folder)
    frames = [(i, 0.0, "316", [s, t, 7, 9] + [0] * 12) for i, (s, t) in enumerate((s, t) for s in range(3) for t in range(9))]
    got = {}
    for r in signals.decode(spark.createDataFrame(frames, "frame_idx long, timestamp double, can_id string, data array<int>"), d).collect():
        got.setdefault(r.frame_idx, set()).add(r.signal)
    for i, _, _, data in frames:
        s, t = data[:2]
        want = {"S", "E"} | ({"A"} if s == 0 else set()) | ({"T", "Z"} if s == 1 else set()) | ({"B"} if s == 1 and (t == 2 or 5 <= t <= 7) else set())
        assert got[i] == want, (s, t)


def by_bits(data: list[int], start: int, length: int, order: str, signed: bool, size: int):
    data = data + [0] * (max(8, size) - len(data))
    if order == "little":
        places = [(b // 8, b % 8) for b in range(start, start + length)][::-1]
    else:
        walk = [(byte, bit) for byte in range(len(data) + 9) for bit in range(7, -1, -1)]
        at = walk.index((start // 8, start % 8))
        places = walk[at : at + length]
    if not 1 <= length <= 64 or any(byte >= len(data) for byte, _ in places):
        return None
    v = 0
    for byte, bit in places:
        v = 2 * v + (data[byte] >> bit & 1)
    return v - (1 << length) if signed and v >> (length - 1) else v


def test_bit_fields_in_frames_of_any_length(spark):
    r = random.Random(8)
    rows = []
    for i in range(1500):
        n = r.choice([0, 3, 8, 12, 64])
        rows.append((i, [r.choice([0, 255, r.randrange(256)]) for _ in range(n)], r.randrange(8 * max(n, 8)), r.choice([0, 1, 7, 8, 12, 33, 57, 63, 64, 65]), r.choice(["little", "big"]), r.random() < 0.5, r.choice([8, n, 16])))
    df = spark.createDataFrame(rows, "i int, data array<int>, start int, length int, o string, signed boolean, size int")
    raw = signals.raw_value(F.col("data"), F.col("start"), F.col("length"), F.col("o"), F.col("signed"), F.col("size"))
    got = {x.i: (x.raw, x.number) for x in df.select("i", raw.alias("raw"), signals.number(raw, F.col("length"), F.col("signed")).alias("number")).collect()}
    wide = 0
    for i, *args in rows:
        want = by_bits(*args)
        wide += want is not None and want >= 1 << 63
        assert got[i] == ((None, None) if want is None else ((want + (1 << 63)) % (1 << 64) - (1 << 63), float(want))), args
    assert wide > 3
