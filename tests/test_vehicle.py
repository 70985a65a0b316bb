"""Hand-computed expectations of the vehicle operators."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from torquelake.functions import dims
from torquelake.operators import codes, detect, protocol, report, retrieval, signals, tools, windows
from torquelake.sources import corpus, dbc, frames


def one(df):
    return df.first()


def frame_rows(spark, n, attack_from=None, ids=("0316",)):
    rows = [(i, i * 0.001, ids[i % len(ids)], 8, [i % 256] * 8, int(attack_from is not None and i >= attack_from)) for i in range(n)]
    return spark.createDataFrame(rows, "frame_idx long, timestamp double, can_id string, dlc int, data array<int>, label int")


def test_variable_and_fixed_lines(spark):
    lines = spark.createDataFrame([("1.5,0316,8,00,01,02,03,04,05,06,ff,R",), ("2.5,02a0,2,0a,0B,T",), ("x,y",)], "value string")
    got = frames.parse_variable(lines).orderBy("timestamp").collect()
    assert [(r.can_id, r.dlc, r.data, r.label) for r in got] == [("0316", 8, [0, 1, 2, 3, 4, 5, 6, 255], 0), ("02A0", 2, [10, 11, 0, 0, 0, 0, 0, 0], 1)]
    fixed = frames.parse_fixed(lines).collect()
    assert [r.flag for r in fixed] == ["R", "", ""] and fixed[1].d2 == "T"


def test_index_is_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    assert [r.frame_idx for r in frames.index_frames(df, "k").orderBy("k").collect()] == list(range(1000))


def test_features(spark):
    f = windows.add_features(frame_rows(spark, 300, ids=("0316", "0260")), block=1024).orderBy("frame_idx").collect()
    assert f[0].inter_arrival == 0 and f[1].inter_arrival == pytest.approx(0.0009995003)
    assert f[-1].id_freq == pytest.approx(0.5, abs=0.01)
    with pytest.raises(ValueError):
        windows.temporal_split(frame_rows(spark, 3), 3, 1.0)


def test_features_across_blocks(spark):
    df = frame_rows(spark, 500, ids=("A", "B", "A"))
    a = windows.add_features(df, id_window=40, block=64).orderBy("frame_idx").collect()
    ids = ["A", "B", "A"]
    for i, r in enumerate(a):
        past = [ids[j % 3] for j in range(max(0, i - 39), i + 1)]
        assert r.id_freq == pytest.approx(past.count(ids[i % 3]) / len(past))
        assert (r.inter_arrival > 0) == (i > 0)


def test_windows_and_labels(spark):
    w = windows.sliding_windows(frame_rows(spark, 10, 8), 10, 10, 10)
    assert one(windows.window_labels(w)).y == 1  # 2 of 10
    w = windows.sliding_windows(frame_rows(spark, 10, 9), 10, 10, 10)
    assert one(windows.window_labels(w)).y == 0  # exactly 0.1 is not over it
    assert windows.sliding_windows(frame_rows(spark, 5), 5, 10, 5).count() == 0
    assert windows.sliding_windows(frame_rows(spark, 100), 100, 8, 20).select("window_id").distinct().count() == 5


def test_calibration_and_metrics(spark):
    s = spark.range(100).select(F.col("id").cast("double").alias("score"))
    assert one(detect.calibrate_upper(s)).threshold == pytest.approx(97.02)
    assert one(detect.calibrate_bilateral(s)).high == pytest.approx(98.01)
    d = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "score double, y int")
    assert one(detect.roc_auc(d)).auc == 0.75
    assert one(detect.roc_auc(d.where("y = 1"))).auc is None


def test_codes_round_trip(spark):
    df = spark.createDataFrame([(c,) for c in ("P0301", "P0401", "P2002", "U0100", "C0035", "B1234", "BADCO", "P4000", None)], "code string")
    got = df.select("code", protocol.code_to_hex(F.col("code")).alias("h")).withColumn("back", protocol.hex_to_code(F.col("h"))).collect()
    assert all(r.back == r.code for r in got[:6]) and all(r.h is None for r in got[6:])
    assert [r.v for r in df.select(codes.is_valid(F.col("code")).alias("v")).collect()] == [True] * 6 + [False, True, False]


@pytest.mark.parametrize(("n", "frames_"), [(0, 1), (1, 1), (7, 1), (8, 2), (13, 2), (14, 3), (25, 4), (100, 15), (4095, 586)])
def test_transport_round_trip(spark, n, frames_):
    h = bytes(i % 251 for i in range(n)).hex().upper()
    f = spark.createDataFrame([(1, h)], "m int, h string").select("m", F.posexplode(protocol.encode_frames(F.col("h"))).alias("i", "frame"))
    rows = f.collect()
    assert len(rows) == frames_ and all(len(r.frame) == 16 for r in rows)
    assert one(protocol.reassemble(f, "m", "i")).payload == h


def test_transport_errors(spark):
    f = spark.createDataFrame([(1, 0, "2100000000000000"), (2, 0, "100A010203040506"), (2, 1, "2300000000000000"), (3, 0, "3000000000000000"), (3, 1, "F000000000000000")], "m int, i int, frame string")
    assert {r.m: r.error for r in protocol.reassemble(f, "m", "i").collect()} == {1: "no first frame", 2: "bad sequence", 3: "unknown frame type"}


def test_transport_of_payloads_of_every_length(spark):
    sizes = [0, 1, 7, 8, 4000, 4001, 4095, 4096, 9000]
    p = spark.createDataFrame([(n, "5A" * n) for n in sizes] + [(None, None)], "m int, h string").withColumn("frames", protocol.encode_frames(F.col("h")))
    got = {r.m: (r.k, r.n) for r in p.select("m", F.when(F.col("frames").isNotNull(), F.size("frames")).alias("k"), protocol.frame_count(F.length("h") / 2).alias("n")).collect()}
    assert got == {0: (1, 1), 1: (1, 1), 7: (1, 1), 8: (2, 2), 4000: (572, 572), 4001: (572, 572), 4095: (586, 586), 4096: (None, None), 9000: (None, None), None: (None, None)}
    back = protocol.reassemble(p.select("m", F.posexplode("frames").alias("i", "frame")), "m", "i").collect()
    assert {r.m: r.payload for r in back} == {n: "5A" * n for n in sizes if n <= 4095}


def test_full_scan_report(spark):
    faults = protocol.full_scan(spark)
    assert {r.code: r.status for r in faults.collect()} == {"P0301": 9, "P0401": 8, "P2002": 12}
    stats = spark.createDataFrame([("N", 617.0, 15.0, 596.0, 662.0, 610.0, 9), ("VS", 0.0, 0.0, 0.0, 0.0, 0.0, 9)], "signal string, mean double, std double, min double, max double, latest double, count long")
    r = report.to_dict(report.build(faults, stats))
    assert r["health"]["score"] == 16 and r["health"]["verdict_en"] == "Immediate action required"
    assert r["repair_plan"][0]["code"] == "P0301" and r["vehicle"]["manufacturer"] == "Audi"
    by = {(c["code"], c["freeze_condition"]): c for c in r["correlation"]}
    assert by["P0301", "engine_rpm"]["z_score"] == 0 and by["P0301", "engine_rpm"]["within_live_range"]
    assert not by["P0401", "engine_rpm"]["within_live_range"] and by["P0401", "vehicle_speed"]["z_score"] is None
    assert "P0301" in report.markdown(r)
    assert one(codes.health_score(faults.limit(0))).score == 100


def test_raw_values(spark):
    data = [0x12, 0x34, 0x56, 0x78, 0x9A, 0xBC, 0xDE, 0xF0]
    be, le = int.from_bytes(bytes(data), "big"), int.from_bytes(bytes(data), "little")
    rows, want = [], []
    for start, n, order, sign in ((7, 16, "big", False), (0, 12, "little", True), (39, 8, "big", True), (4, 60, "little", False), (7, 64, "big", True), (60, 10, "little", False)):
        rows.append((data, start, n, order, sign))
        shift = start if order == "little" else 64 - (8 * (start // 8) + 7 - start % 8) - n
        v = None if shift + n > 64 or shift < 0 else ((le if order == "little" else be) >> shift) & ((1 << n) - 1)
        want.append(v - (1 << n) if v is not None and sign and v >> (n - 1) else v)
    df = spark.createDataFrame(rows, "data array<int>, s int, n int, o string, g boolean").repartition(1)
    assert [r[0] for r in df.select(signals.raw_value(*[F.col(c) for c in ("data", "s", "n", "o", "g")])).collect()] == want


def test_dbc_source(spark, tmp_path):
    (tmp_path / "hyundai_x.dbc").write_text('BO_ 790 EMS: 8 ECU\n SG_ N : 16|16@1+ (0.25,0) [0|8000] "rpm" X\n SG_ broken\nVAL_ 790 N 1 "on" ;\n')
    (tmp_path / "empty.dbc").write_text("nothing")
    d = dbc.read_dbc(spark, str(tmp_path)).cache()
    info = {r.dbc: (r.loaded, r.load_mode, r.n_messages) for r in dbc.file_info(d).collect()}
    assert info == {"hyundai_x.dbc": (True, "permissive", 1), "empty.dbc": (False, "failed", 0)}
    assert dbc.find_signal(d, "n").count() == 1 and one(dbc.list_messages(d)).hex_id == "316"
    f = spark.createDataFrame([(0, 0.0, "0316", [0, 0, 8, 0]), (1, 0.1, "316", [0, 0, 1, 0]), (2, 0.1, "999", [0])], "frame_idx long, timestamp double, can_id string, data array<int>")
    assert [(r.frame_idx, r.value) for r in signals.decode(f, d).collect()] == [(0, 2.0)]  # raw 1 is a named state


def test_multiplexed_signals(spark, tmp_path):
    lines = ["BO_ 790 MX: 8 ECU", ' SG_ S M : 0|4@1+ (1,0) [0|15] "" X', ' SG_ A m0 : 8|8@1+ (1,0) [0|255] "" X', ' SG_ B m3 : 8|8@1+ (2,0) [0|510] "" X', ' SG_ C : 16|8@1+ (1,0) [0|255] "" X']
    (tmp_path / "m.dbc").write_text("\n".join(lines))
    d = dbc.read_dbc(spark, str(tmp_path))
    assert {r.signal: r.mux for r in d.collect()} == {"S": "M", "A": "m0", "B": "m3", "C": None}
    f = spark.createDataFrame([(0, 0.0, "316", [0, 5, 9]), (1, 0.1, "316", [3, 5, 9]), (2, 0.2, "316", [1, 5, 9])], "frame_idx long, timestamp double, can_id string, data array<int>")
    got = {(r.frame_idx, r.signal): r.value for r in signals.decode(f, d).collect()}
    assert got == {(0, "S"): 0, (0, "A"): 5, (0, "C"): 9, (1, "S"): 3, (1, "B"): 10, (1, "C"): 9, (2, "S"): 1, (2, "C"): 9}


def test_corpus(spark, tmp_path):
    case = '{"id":"case-1","dtc_codes":["p0301"],"brands":["Kia"],"engine_family":"e","system":"s","symptoms_fr":"a","symptoms_en":"b","root_cause_fr":"c","root_cause_en":"d","fix_fr":"e","fix_en":"f","confirmed":true}'
    bad = case.replace('"case-1"', '"case-2"').replace("p0301", "X1").replace('"fix_en":"f"', '"fix_en":" "')
    (tmp_path / "kb.json").write_text('{"cases":[' + ",".join([case, case, bad]) + "]}")
    cases = corpus.read_cases(spark, str(tmp_path / "kb.json"))
    found = [r.message for r in corpus.violations(cases).orderBy("pos", "rule_no").collect()]
    assert found == ["case-1: duplicate case id", "case-2: invalid DTC code format 'X1'", "case-2: field 'fix_en' is empty"]
    docs = corpus.flatten(cases.limit(1))
    assert {r.doc_id for r in docs.collect()} == {"case-1-fr", "case-1-en"}
    ns = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    assert one(docs.select("doc_id", corpus.point_id(ns, F.col("doc_id")).alias("p")).where("doc_id = 'case-1-fr'")).p == str(uuid.uuid5(uuid.UUID(ns), "case-1-fr"))


def test_tokens_and_fusion(spark):
    t = spark.createDataFrame([("régénération dégradé",), ("code P0301 stocké",), ("!!! ???",), (None,)], "t string").select(retrieval.tokens(F.col("t")))
    assert [r[0] for r in t.collect()] == [["regeneration", "degrade"], ["code", "p0301", "stocke"], [], []]
    r = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query int, case string, rank int")
    top = retrieval.rrf(r, r, "case", 3).orderBy("rank").collect()
    assert [x.case for x in top] == ["a", "b"] and top[0].score == pytest.approx(2 / 61)


def test_tools_answer(spark):
    said = tools.call(spark, "decode_dtc", {"code": "p0301"})
    assert all(x in said for x in ("P0301", "Powertrain", "Cylinder 1 misfire detected"))
    assert tools.call(spark, "decode_vin", {"vin": "x"}).startswith("Error") and tools.call(spark, "nothing", {}).startswith("Error")
    assert len(dims.DECLINE_MARKERS) == 19 and len(dims.YEARS) == 17


def test_rejected_codes(spark):
    given = spark.createDataFrame([(1, "P0301"), (2, "X1"), (3, None), (4, "X1"), (5, "p0420 ")], "at long, code string")
    got = codes.rejected(codes.interpret(given), "at").collect()
    assert sorted((r["first_at"], r["code"], r["times"]) for r in got) == [(2, "X1", 2), (3, None, 1), (5, "p0420 ", 1)]
    assert codes.rejected(codes.interpret(given.where("at = 1")), "at").count() == 0


def test_signal_lookup_takes_the_first_definition(spark):
    cols = "dbc string, frame_id long, message string, signal string, pos int, start_bit int, length_bits int, byte_order string, is_signed boolean, scale double, offset double, unit string, minimum double, maximum double"
    rule = ("little", False, 0.5, -40.0, None, 0.0, 100.0)
    rows = [("b.dbc", 1, "B", "T", 0, 0, 8, *rule), ("a.dbc", 300, "A2", "T", 0, 8, 8, *rule), ("a.dbc", 255, "A1", "T", 1, 16, 8, *rule), ("c.dbc", None, None, None, *[None] * 10)]
    asked = spark.createDataFrame([("T",), ("t",), (None,), ("T",)], "signal string")
    got = {r["signal"]: r for r in signals.lookup(spark.createDataFrame(rows, cols), asked).collect()}
    assert len(got) == 3 and (got["T"]["message"], got["T"]["can_id_hex"], got["T"]["start_bit"], got["T"]["unit"], got["T"]["error"]) == ("A1", "FF", 16, "", None)
    assert [got[k]["found"] for k in ("T", "t", None)] == [True, False, False] and got["t"]["error"] == "Signal 't' not in DBC"
