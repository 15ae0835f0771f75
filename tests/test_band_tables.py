import json

import pytest

from prosegrain.plans import band_tables, cli, settings

TABLE = {"name": "memo", "description": "short notes", "rules": {"W-M1": {"direction": "ai-high", "human_universal": [0, 1.5], "ai_universal": 9}, "T-M3": {"direction": "human-high", "human_universal": [0, 2], "human_internal": [0, 1]}}}


def test_tables_are_found_and_checked(tmp_path):
    for scope in ("project", "shipped"):
        settings.write_json(tmp_path / scope / "memo.json", TABLE | {"description": scope})
    scopes = {s: tmp_path / s for s in ("project", "personal", "shipped")}
    table, scope = band_tables.named("memo", scopes)
    assert (table["description"], scope) == ("project", "project")
    assert band_tables.named(str(tmp_path / "shipped/memo.json"), scopes)[0]["description"] == "shipped"
    with pytest.raises(ValueError):
        band_tables.named("other", scopes)
    for change in ({"rules": {"Q-1": {"direction": "ai-high"}}}, {"rules": {"W-M1": {}}}, {"rules": {"W-M1": {"direction": "up"}}}, {"rules": {"W-M1": {"direction": "ai-high", "human_universal": [1]}}}, {"name": ""}):
        assert len(band_tables.errors(TABLE | change)) == 1
    assert band_tables.errors([]) and band_tables.errors(TABLE) == []
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(ValueError):
        band_tables.load(tmp_path / "bad.json")
    assert band_tables.lines(TABLE, "project")[0] == "memo (project): 2 rules"


def test_rows_for_verdicts(spark):
    rows = {r.rule: r for r in band_tables.frame(spark, TABLE).collect()}
    assert (rows["W-M1"].hu_lo, rows["W-M1"].hu_hi, rows["W-M1"].hi_lo, rows["W-M1"].ai_u, rows["W-M1"].ai_i) == (0.0, 1.5, None, 9.0, None)
    assert (rows["T-M3"].direction, rows["T-M3"].hi_hi) == ("human-high", 1.0)


def test_check_with_bands(spark, tmp_path, capsys):
    settings.write_json(tmp_path / "memo.json", TABLE)
    (tmp_path / "long.md").write_text(("Plain words — and more of them follow here today. " * 40).strip())
    bands = str(tmp_path / "memo.json")
    assert cli.main(["check", "--bands", bands, "--rules", "W-M1", str(tmp_path / "long.md")]) == 1
    said = capsys.readouterr().err
    assert "W-M1" in said and "FAIL" in said and "ai-range" in said
    (tmp_path / "short.md").write_text("Fine.")
    assert cli.main(["check", "--bands", bands, str(tmp_path / "short.md")]) == 0
    assert "too few words" in capsys.readouterr().err
    assert cli.main(["check", "--bands", str(tmp_path / "none.json"), str(tmp_path / "short.md")]) == 2
    assert cli.main(["check", "--bands", bands, "--json", "--rules", "W-M1", str(tmp_path / "long.md")]) == 1
    report = json.loads(capsys.readouterr().out)
    assert report["bands"]["rules"]["W-M1"]["status"] == "FAIL" and len(report["findings"]) == 40 and report["counts"] == {"findings": 40, "rules_checked": 1} and report["by_rule"] == {"W-M1": 40}
    capsys.readouterr()
    assert cli.main(["bands", "show", bands]) == 0 and "memo (path): 2 rules" in capsys.readouterr().out
