import json

import pytest
from pyspark.sql import functions as F

from prosegrain.operators import parse_rules as P
from prosegrain.plans import cli, settings
from prosegrain.plans.schema import Checker
from prosegrain.sources import readers, writers


def test_precedence():
    voice = {"checks": ["W-M1", "T-M3"], "bands": "code", "extend": ["v"]}
    r = settings.resolve({"extend": ["f"]}, voice, {"bands": "chat", "extend": ["c", "f"]})
    assert (r.rules, r.bands, r.lexicon, r.extend) == (["W-M1", "T-M3"], "code", "universal-code", ["f", "v", "c"])
    assert settings.resolve({"rules": "technical"}).bands == "doc-technical"
    assert settings.resolve({"rules": "W-M1", "bands": "chat"}, voice).bands == "chat"


def test_scopes(tmp_path):
    for scope, name in (("project", "a"), ("personal", "a"), ("personal", "b")):
        settings.write_json(tmp_path / scope / f"{name}.json", {"s": scope})
    scopes = {s: tmp_path / s for s in ("project", "personal", "shipped")}
    assert settings.first_found("a", scopes)[1] == "project"
    assert settings.catalog(scopes) == {"a": "project", "b": "personal"}
    with pytest.raises(ValueError):
        settings.first_found("zz", scopes)
    assert settings.write_json(tmp_path / "project" / "a.json", {"s": "project"}) is False


def test_voices():
    old = settings.upgraded({"name": "n", "surface": "doc-technical", "rules": []})
    assert old["bands"] == "doc-technical" and "T-M12" in old["checks"] and old["rubric"] == []
    doc = {"checks": ["W-M1", "W-M2"]}
    assert settings.edited_voice(doc, "checks", ["+W-M3", "-W-M1"])["checks"] == ["W-M2", "W-M3"]
    assert settings.edited_voice(doc, "checks", ["T-M1"])["checks"] == ["T-M1"]
    base = {"rubric": [{"name": "a", "x": 1}, {"name": "b"}]}
    assert settings.merged_voice(base, {"rubric": [{"name": "a", "y": 2}]})["rubric"] == [{"name": "a", "x": 1, "y": 2}, {"name": "b"}]
    scale = lambda name, low, high, need, *anchors: {"name": name, "scoring": {"type": "scale", "min": low, "max": high, "anchors": dict.fromkeys(anchors, "?")}, "requirement": need}
    yes_no = lambda name, need: {"name": name, "scoring": {"type": "pass-fail"}, "requirement": need}
    assert settings.rubric_errors([scale("a", 1, 5, {"min": 4}, "1", "5"), yes_no("b", {"pass": True})]) == []
    wrong = [scale("a", 1, 5, {"min": 7}, "9"), scale("b", 5, 5, {}), yes_no("a", {}), scale("c", 0, 3, {"min": 0}, "x")]
    assert [e.split(": ")[0] for e in settings.rubric_errors(wrong)] == ["rubric[2].name", "rubric[0].requirement.min", "rubric[0].scoring.anchors", "rubric[1].requirement", "rubric[1].scoring", "rubric[2].requirement", "rubric[3].scoring.anchors"]
    text = settings.rubric_text({"name": "n", "bands": "chat", "checks": [], "rubric": [{"name": "r", "description": "d", "criteria": ["c"], "scoring": {"type": "pass-fail"}, "requirement": {"pass": True}}]})
    assert "1. r · pass/fail · must pass" in text and "universal-chat" in text


def test_schema():
    c = Checker({"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer"}, "b": {"oneOf": [{"const": 1}, {"$ref": "#/d"}]}, "c": {"type": "array", "minItems": 1, "items": {"enum": ["x"]}}}, "d": {"type": "string", "minLength": 2, "pattern": "^q"}})
    assert c.errors({"a": 1, "b": "qq", "c": ["x"]}) == []
    assert len(c.errors({"a": True, "z": 1, "c": [], "b": "x"})) == 4
    assert c.errors({}) == ["document.a: is required"]
    assert c.errors([]) == ["document: must be of type object"]
    assert c.errors({"a": 1, "c": ["x", "y"]})[0].startswith("document.c[1]: must be one of")


def test_front_matter():
    assert settings.front_matter("---\na: 1\n---\nrest") == ({"a": "1"}, "rest")
    assert settings.front_matter("no") == ({}, "no")


def test_readers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("one\r\ntwo")
    (tmp_path / "sub/b.txt").write_text("  \n")
    (tmp_path / "sub/c.md").write_text("x `y` z\n```\ncode\n```\n")
    assert [r.text for r in readers.text_files(spark, str(tmp_path)).collect()] == ["one\ntwo"]
    assert readers.check_files(spark, str(tmp_path)).count() == 3
    (t,) = spark.createDataFrame([("x `y` z\n```\ncode\n```\nend ```open",)], "t string").select(readers.without_code(F.col("t")).alias("t")).collect()
    assert "code" not in t.t and "y" not in t.t and "open" in t.t
    rows = ['{"text": "a", "x": {"text": "no"}}', '[{"m": {"text": "b"}}, {"text": {"text": "c"}}]', "bad {", '{"text": 5}', '{"q": [[{"text": "d"}]]}', "7"]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "id int, value string")
    assert sorted((r.id, r.text) for r in readers.json_texts(df).collect()) == [(0, "a"), (1, "b"), (1, "c"), (4, "d")]
    p = readers.pieces(spark.createDataFrame([("f", "a\n\nb\n \nc")], "path string, text string"), "blank")
    assert sorted((r.path, r.text) for r in p.collect()) == [("f#0", "a"), ("f#1", "b"), ("f#2", "c")]


def test_lexicon_files(spark, tmp_path):
    doc = {"meta": {"params": {"zipf_gate": None, "stoplist": {"terms": ["brook", "w"]}}}, "jargon": {"seam": {"contrast_count": 9, "approved_count": 0, "log_likelihood": 20.0, "log_ratio": 4.0, "contrast_doc_share": 0.5, "approved_doc_share": 0.0, "zipf_en": 0.0}}, "approved_vocabulary": {"w": {"approved_count": 4, "approved_doc_share": 0.2}}}
    (tmp_path / "l.json").write_text(json.dumps(doc))
    lex = readers.read_lexicon(spark, str(tmp_path / "l.json"))
    assert lex.zipf_gate == 5.0 and lex.stoplist == ("brook", "w")
    assert sorted((r.term, r.source) for r in lex.approved.collect()) == [("brook", "stoplist"), ("w", None)]
    writers.write_lexicon_tables(lex, str(tmp_path / "t"))
    assert writers.read_lexicon_tables(spark, str(tmp_path / "t")).jargon.count() == 1
    writers.write_lexicon_json(lex, spark.range(1).select(F.lit(3).alias("approved_docs")), str(tmp_path / "j"))
    assert readers.read_lexicon(spark, str(tmp_path / "j")).jargon.first().log_ratio == 4.0
    (tmp_path / "x.json").write_text("{}")
    with pytest.raises(ValueError):
        readers.read_lexicon(spark, str(tmp_path / "x.json"))
    (tmp_path / "s.txt").write_text("# names\nBrook  # river\n\nshore\n")
    assert sorted(r.term for r in readers.read_stoplist(spark, str(tmp_path / "s.txt")).collect()) == ["brook", "shore"]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.md").write_text("One — two.")
    assert cli.main(["check", str(tmp_path / "a.md")]) == 1
    assert '[W-M1] em dash: "One — two."' in capsys.readouterr().out
    (tmp_path / "b.md").write_text("Fine.")
    assert cli.main(["check", str(tmp_path / "b.md")]) == 0
    assert cli.main(["check", str(tmp_path / "none")]) == 2
    assert cli.main(["check", "--rules", "Z-1", str(tmp_path / "a.md")]) == 2


def tokens(spark, sentence, rows):
    """rows: (text, pos, tag, dep, head)"""
    return spark.createDataFrame([("p", 1, 0, sentence, i, 1, t, pos, tag, dep, head, None if pos not in ("NOUN", "PROPN", "ADJ", "DET") else 0, False, pos == "PUNCT") for i, (t, pos, tag, dep, head) in enumerate(rows)], P.TOKENS)


def test_parse_rules(spark):
    go = tokens(spark, "Open and close the lid now", [("Open", "VERB", "VB", "ROOT", 0), ("and", "CCONJ", "CC", "cc", 0), ("close", "VERB", "VB", "conj", 0), ("lid", "NOUN", "NN", "dobj", 2)])
    assert [r.label for r in P.one_instruction(go).collect()] == ["2 instructions (Open, close)"]
    long = " ".join(["word"] * 21)
    imperative = tokens(spark, long, [("word", "VERB", "VB", "ROOT", 0), ("word", "NOUN", "NN", "dobj", 0), ("word", "NOUN", "NN", "dobj", 0)])
    assert [r.label for r in P.sentence_length(imperative).collect()] == ["21-word instruction, limit 20"]
    told = tokens(spark, long, [("word", "VERB", "VB", "ROOT", 0), ("it", "PRON", "PRP", "nsubj", 0), ("word", "NOUN", "NN", "dobj", 0)])
    assert P.sentence_length(told).count() == 0
    have = tokens(spark, "It has been done", [("It", "PRON", "PRP", "nsubjpass", 3), ("has", "AUX", "VBZ", "aux", 3), ("been", "AUX", "VBN", "auxpass", 3), ("done", "VERB", "VBN", "ROOT", 3)])
    assert [r.label for r in P.simple_tenses(have).collect()] == ["perfect tense (has been)"]
    assert [r.label for r in P.passive_voice(have).collect()] == ["passive clause (done)"]
    going = tokens(spark, "Going to the shop", [("Going", "VERB", "VBG", "ROOT", 0), ("to", "ADP", "IN", "prep", 0), ("shop", "NOUN", "NN", "pobj", 1)])
    assert [r.label for r in P.ing_main_verb(going).collect()] == ["-ing main verb (Going)"]
    nouns = tokens(spark, "x", [("the", "DET", "DT", "det", 4), ("a", "NOUN", "NN", "c", 4), ("b", "NOUN", "NN", "c", 4), ("c", "PROPN", "NN", "c", 4), ("d", "NOUN", "NN", "ROOT", 4)])
    assert [(r.label, r.match) for r in P.noun_clusters(nouns).collect()] == [("4 nouns in a row", "a b c d")]
    item = tokens(spark, "You should press it", [("You", "PRON", "PRP", "nsubj", 2), ("should", "AUX", "MD", "aux", 2), ("press", "VERB", "VB", "ROOT", 2), ("it", "PRON", "PRP", "dobj", 2)])
    assert [(r.label, r.fix) for r in P.non_imperative(item).collect()] == [("non-imperative instruction (You should)", "Press ...")]


def test_streams(spark, tmp_path):
    from prosegrain import streaming as ST

    spark.createDataFrame([("a", "One — two — three.")], "path string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, text string").parquet(str(tmp_path / "in"))
    q = ST.finding_counts_stream(stream, ["W-M1"]).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("counts").collect()] == [("W-M1", 2)]
