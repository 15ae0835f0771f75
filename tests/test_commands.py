"""The command line: lexicons, extensions, scores, comparison, checks with voices and configuration, reports."""

import io
import json

import pytest

from prosegrain.plans import cli, documents, settings

GOOD = ["our parcel reached the harbour crew", "the harbour crew opened a parcel", "a crew member signed for the parcel", "parcel crew parcel harbour"] * 3
BAD = ["the flywheel drives a cog wheel", "a cog behind the flywheel drives"] * 6


@pytest.fixture
def home(tmp_path, monkeypatch):
    """A home and a working folder of one's own."""
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    (tmp_path / "work/deep/er").mkdir(parents=True)
    (tmp_path / "home").mkdir()
    monkeypatch.chdir(tmp_path / "work/deep/er")
    return tmp_path


def put(folder, texts):
    folder.mkdir(parents=True, exist_ok=True)
    for k, t in enumerate(texts):
        (folder / f"d{k:02}.txt").write_text(t)
    return str(folder)


def run(capsys, *argv, code=0):
    capsys.readouterr()
    assert cli.main([str(a) for a in argv]) == code
    return capsys.readouterr()


@pytest.fixture
def lexicon(spark, home, capsys):
    folder = home / "home/.prosegrain/lexicons/mine"
    said = run(capsys, "build", put(home / "good", GOOD), put(home / "bad", BAD), "-o", folder, "--ll", 0, "--lr", 1, "--min-contrast-dispersion", 0.1, "--max-approved-dispersion", 0.01)
    assert "jargon terms" in said.out and "flywheel" in said.out and "under 30000" in said.err
    return "mine"


def test_scores_of_a_folder(spark, home, capsys, lexicon):
    target = put(home / "t", ["the flywheel and the flywheel of a cog", "harbour crew", "zebra crew zebra"])
    said = run(capsys, "score", target, "-l", lexicon, "--top", 1).out
    assert "3 docs" in said and "docs with jargon: 1/3" in said and "flywheel" in said and "... 2 more files" in said
    doc = json.loads(run(capsys, "score", target, "-l", lexicon, "--json").out)
    assert doc["docs"] == 3 and [f["file"] for f in doc["files"]] == ["d00.txt", "d01.txt", "d02.txt"]
    assert doc["top_flagged"][0] == ["flywheel", 2] and doc["top_unapproved_unigrams"] == [["zebra", 1, 2]]
    assert doc["files"][0]["top_terms"][0] == "flywheel" and doc["files"][2]["top_unapproved"] == ["zebra"]


def test_scores_of_a_file(spark, home, capsys, lexicon):
    target = put(home / "t", ["The flywheel turns a cog here. Our crew is fine now. " + "A flywheel " + "x" * 200 + " goes."]) + "/d00.txt"
    doc = json.loads(run(capsys, "score", target, "-l", lexicon, "--json").out)
    assert doc["flagged"]["flywheel"]["count"] == 2 and [s["terms"][0] for s in doc["sentences_with_jargon"] if s["terms"]] == ["cog", "flywheel"]
    assert max(len(s["sentence"]) for s in doc["sentences_with_jargon"]) == 160
    assert "flywheel" in run(capsys, "score", target, "-l", lexicon).out
    run(capsys, "score", target, "-l", "none", code=2)


def test_extensions_veto_and_add(spark, home, capsys, lexicon):
    assert "no extensions" in run(capsys, "extensions").err
    corpus = put(home / "more", ["cog wheel cog wheel zebra cog"] * 6)
    (home / "more/r.jsonl").write_text('{"text": "zebra zebra herd"}\n{"text": "zebra cog herd"}\nbad\n{"text": "x"}')
    said = run(capsys, "extend", "farm", corpus, "--note", "beasts").out
    assert "farm: 8 docs" in said and "1 of under three tokens left out" in said
    assert "beasts" in run(capsys, "extensions").out and "farm" in run(capsys, "extensions").out
    target = put(home / "t", ["cog zebra flywheel"])
    said = run(capsys, "score", target, "-l", lexicon, "--extend", "farm", "--json")
    assert "farm (" in said.err and json.loads(said.out)["top_flagged"] == [["flywheel", 1]] and json.loads(said.out)["top_unapproved_unigrams"] == []
    run(capsys, "score", target, "-l", lexicon, "--extend", "none", code=2)
    run(capsys, "extend", "Bad Name", corpus, code=2)
    assert "three tokens" in run(capsys, "extend", "few", put(home / "few", ["a b"]), code=2).err


def test_comparison(spark, home, capsys, lexicon):
    a, b = put(home / "a", ["flywheel crew harbour parcel"] * 5), put(home / "b", ["crew harbour parcel crew"] * 4)
    doc = json.loads(run(capsys, "delta", a, b, "-l", lexicon, "--boot", 50, "--json").out)
    assert doc["unit"] == "documents" and (doc["a"]["units"], doc["b"]["units"]) == (5, 4)
    assert doc["jargon"] == {"a_density": 250.0, "b_density": 0.0, "delta": 250.0, "ci95": [250.0, 250.0], "credible": True}
    assert "jargon (A - B): +250.00" in run(capsys, "delta", a + "/d00.txt", b + "/d00.txt", "-l", lexicon, "--boot", 50).out


VOICE = {"name": "crew", "description": "For the crew.", "checks": ["W-M1", "W-M10", "T-M1"], "bands": "memo", "lexicon": "mine", "rubric": [{"name": "clear", "description": "d", "criteria": ["c"], "scoring": {"type": "pass-fail"}, "requirement": {"pass": True}}]}
TABLE = {"name": "memo", "rules": {"W-M1": {"direction": "ai-high", "human_universal": [0, 1.5], "ai_universal": 9}}}


def test_a_check_with_a_voice(spark, home, capsys, lexicon):
    settings.write_json(home / "work/.prosegrain/bands/memo.json", TABLE)
    settings.write_json(home / "home/.prosegrain/voices/crew.json", VOICE)
    settings.write_json(home / "work/.prosegrain/config.json", {"voice": "crew"})
    text = home / "work/deep/er/a.md"
    text.write_text("The flywheel — a cog. " * 120)
    said = run(capsys, "check", "a.md", code=1)
    assert said.out.count("[W-M1]") == 120 and "[W-M10]" not in said.out
    for part in ("voice: crew (personal, from the configuration)", "lexicon: mine (voice", "note: a.md: jargon density", "jargon (W-M10, advisory): ", "top: ", "checked 2 rules over", "120 findings (1 skipped: T-M1)", "band summary (bands: memo", "human 0-1.5", "ai ~9", "FAIL · ai-range"):
        assert part in said.err, part
    doc = json.loads(run(capsys, "check", "a.md", "--json", "--no-parser", code=1).out)
    assert doc["paths"] == ["a.md"] and doc["rules"] == "crew" and doc["tiers_run"] == ["1", "1b"] and doc["rules_skipped"] == ["T-M1"] and doc["counts"] == {"findings": 120, "rules_checked": 2}
    assert doc["bands"]["rules"]["W-M1"]["human_universal"] == [0, 1.5] and doc["voice"]["scope"] == "personal" and set(doc["findings"][0]) == {"rule", "path", "line", "label", "match"}
    text.write_text("The flywheel turns. A cog — there.")
    doc = json.loads(run(capsys, "check", "a.md", "--json", "-o", "r.json", code=1).out or (home / "work/deep/er/r.json").read_text())
    assert doc["bands"]["guard"] == "small-sample"
    run(capsys, "check", "a.md", "-o", "r.txt", code=1)
    assert (home / "work/deep/er/r.txt").read_text().startswith("a.md:1: [W-M1]")


def test_what_a_check_refuses(spark, home, capsys):
    (home / "work/deep/er/a.md").write_text("Fine text.")
    for argv in (["a.md", "--bands", "none"], ["a.md", "--lexicon", "none"], ["a.md", "--extend", "x"], ["a.md", "--voice", "none"], ["none.md"], ["a.md", "--rules", "Z-1"], ["a.md", "--field", "x"]):
        assert run(capsys, "check", *argv, code=2).err.startswith("error")
    settings.write_json(home / "home/.prosegrain/config.json", {"bands": "Not A Name"})
    assert "no configuration" in run(capsys, "check", "a.md", code=2).err


def test_input_from_the_screen(spark, home, capsys, monkeypatch):
    monkeypatch.setattr("sys.stdin", io.StringIO("One — two."))
    assert run(capsys, "check", code=1).out == '<stdin>:1: [W-M1] em dash: "One — two."\n'


def test_voices(home, capsys, monkeypatch):
    (home / "v.json").write_text(json.dumps({k: v for k, v in VOICE.items() if k != "name"}))
    made = run(capsys, "voice", "new", "crew", home / "v.json").out.strip()
    assert made.endswith("home/.prosegrain/voices/crew.json")
    run(capsys, "voice", "new", "crew", home / "v.json", code=2)
    run(capsys, "voice", "new", "crew", home / "v.json", "--force")
    run(capsys, "voice", "new", "Bad", home / "v.json", code=2)
    (home / "wrong.json").write_text(json.dumps(VOICE | {"name": "other", "checks": ["W-M99", "W-M1", "W-M1"]}))
    assert "no rule W-M99" in (err := run(capsys, "voice", "new", "other", home / "wrong.json", code=2).err) and "twice" in err
    run(capsys, "voice", "set", "crew", "bands", "chat")
    (home / "p.json").write_text(json.dumps({"rubric": [{"name": "clear", "description": "new"}]}))
    run(capsys, "voice", "set", "crew", home / "p.json")
    doc = json.loads(run(capsys, "voice", "rubric", "crew", "--json").out)
    assert doc["bands"] == "chat" and doc["rubric"][0]["description"] == "new" and doc["rubric"][0]["criteria"] == ["c"]
    assert "voice: crew (personal)" in run(capsys, "voice", "rubric", "crew").out
    settings.write_json(home / "work/.prosegrain/voices/crew.json", VOICE)
    listed = run(capsys, "voice", "list").out.splitlines()
    assert [line.split()[:2] for line in listed] == [["crew", "project"], ["crew", "personal"]] and "(hidden)" in listed[1]
    run(capsys, "voice", "rm", "crew")
    assert documents.voice("crew")[1] == "personal"
    assert json.loads(run(capsys, "voice", "schema").out)["required"] == ["name", "checks", "bands"]


def test_bands_and_configuration(home, capsys):
    settings.write_json(home / "work/.prosegrain/bands/memo.json", TABLE | {"meta": {"generated": "today", "unit": "per 1,000"}})
    settings.write_json(home / "home/.prosegrain/bands/bad.json", {"name": "BAD NAME!", "rules": {}, "junk": 1})
    listed = run(capsys, "bands", "list").out.splitlines()
    assert listed[0].split()[:4] == ["memo", "project", "1", "rules"] and " ? rules" in listed[1]
    assert run(capsys, "bands", "show", "memo").out.splitlines() == ["memo (project): 1 rules, generated today, per 1,000", "  W-M1  ai-high     · human 0-1.5 · ai ~9"]
    assert "junk" in (err := run(capsys, "bands", "show", "bad", code=2).err) and "bands.name" in err
    for entry in ({"human_universal": [3, 1]}, {"human_universal": [1, 2, 3]}, {"odd": 1}, {"ai_universal": True}):
        settings.write_json(home / "work/.prosegrain/bands/memo.json", {"name": "memo", "rules": {"W-M1": {"direction": "ai-high", **entry}}})
        run(capsys, "bands", "show", "memo", code=2)
    assert json.loads(run(capsys, "bands", "schema").out)["required"] == ["name", "rules"]
    settings.write_json(home / "home/.prosegrain/config.json", {"bands": "chat", "extend": ["a", "b"]})
    settings.write_json(home / "work/.prosegrain/config.json", {"bands": "memo"})
    said = run(capsys, "config", "show").out
    assert "bands    memo  (project)" in said and "extend   a, b  (personal)" in said
    assert "properties" in run(capsys, "config", "schema").out


def test_ordinary_words_are_no_jargon(spark, home, capsys):
    (home / "zipf.tsv").write_text("flywheel\t5.5\ncog\t2.0\n")
    common = ["build", put(home / "good", GOOD), put(home / "bad", BAD), "--ll", 0, "--lr", 1, "--min-contrast-dispersion", 0.1, "--max-approved-dispersion", 0.01, "--zipf", home / "zipf.tsv"]
    run(capsys, *common, "-o", home / "l1")
    run(capsys, *common, "-o", home / "l2", "--zipf-gate", 6)
    jargon = [{r.term for r in spark.read.parquet(str(home / name / "jargon")).collect()} for name in ("l1", "l2")]
    assert "flywheel" in jargon[1] - jargon[0] and "cog" in jargon[0]
