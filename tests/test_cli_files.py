"""Commands that read and write files."""

from __future__ import annotations

import json

from torquelake import cli


def test_analyze_can_reads_the_first_lines_and_writes_signals(spark, tmp_path, capsys):
    (tmp_path / "log.csv").write_text("".join(f"{100 - i}.0,0316,8,00,{i:02x},00,00,00,00,00,00,{'T' if i == 3 else 'R'}\n" for i in range(50)))
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.dbc").write_text('BO_ 790 EMS: 8 ECU\n SG_ N : 8|8@1+ (2,0) [0|510] "" X\n')
    args = ["analyze-can", str(tmp_path / "log.csv"), "--dbc-dir", str(tmp_path / "d"), "--rows", "10", "--out", str(tmp_path / "out")]
    assert cli.main(args) == 0
    assert "frames decoded: 9" in capsys.readouterr().out
    got = spark.read.parquet(f"file://{tmp_path}/out/signals.parquet").collect()
    assert sorted(r.value for r in got) == [2.0 * i for i in range(10) if i != 3]
    (tmp_path / "d/x.dbc").write_text('BO_ 7 EMS: 8 ECU\n SG_ N : 8|8@1+ (2,0) [0|510] "" X\n')
    assert cli.main(args) == 1


def test_evaluate_retrieval(spark, tmp_path, capsys):
    case = {"id": "case-001", "dtc_codes": ["P0420"], "brands": ["Kia"], "engine_family": "G4", "system": "s", "confirmed": True}
    texts = {f"{k}_{lang}": f"{k} coil" for k in ("symptoms", "root_cause", "fix") for lang in ("fr", "en")}
    other = {k: "belt" for k in texts}
    (tmp_path / "c.json").write_text(json.dumps({"cases": [case | texts, case | other | {"id": "case-002"}]}))
    (tmp_path / "q.json").write_text(json.dumps({"queries": [{"id": "q1", "lang": "en", "query": "bad coil", "relevant_cases": ["case-001"]}, {"id": "q2", "lang": "fr", "query": "coil", "relevant_cases": ["case-002"]}]}))
    out = tmp_path / "r/e.json"
    assert cli.main(["evaluate-retrieval", str(tmp_path / "c.json"), str(tmp_path / "q.json"), "--out", str(out)]) == 0
    found = json.loads(out.read_text())
    assert found["summary"]["n"] == 2 and found["summary"]["hit_1"] == 0.5 and found["summary"]["mrr"] == 0.75
    assert {r["lang"]: r["hit_1"] for r in found["by_lang"]} == {"en": 1.0, "fr": 0.0}
    assert cli.main(["evaluate-retrieval", str(tmp_path / "none.json"), str(tmp_path / "q.json")]) == 2
