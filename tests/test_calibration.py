"""Scans of corpora, digests in order, and a calibration run: its checks, its reuse and its folder."""

import hashlib
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from prosegrain.functions.text import lenient
from prosegrain.operators import parse_rules as P
from prosegrain.operators.digests import ordered_digests
from prosegrain.plans import calibration as C
from prosegrain.plans import cli
from prosegrain.sources import readers

TOKENS = "label string, " + P.TOKENS


def put(folder, files):
    for name, text in files.items():
        at = folder / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(text if isinstance(text, bytes) else text.encode())


def manifest(tmp_path, **changes):
    corpora = []
    for s in C.SURFACES:
        for side, text in (("human", "We delve into it. Plain words stand here."), ("ai", "Certainly — it is robust — and we delve.")):
            label = f"{s} {side}"
            put(tmp_path / "corpora" / label, {"a.txt": text, "b/c.txt": text + "\r\nMore words follow here.", "skip.md": "robust"})
            corpora.append({"label": label, "path": f"corpora/{label}", "surface": s, "side": side, "origin": "universal"})
    doc = {"corpora": corpora}
    put(tmp_path, {"m.json": json.dumps(doc)})
    return doc


@pytest.fixture
def parses(spark):
    token = lambda label, i, tag, dep: (label, "a.txt", 1, 0, "We were told things.", i, 1, f"t{i}", "VERB", tag, dep, 1, None, False, False)
    rows = [token("chat ai", i, "VBG" if i == 1 else "NN", "nsubjpass" if i == 0 else "dep") for i in range(4)]
    tokens = spark.createDataFrame(rows, TOKENS)
    return tokens, tokens.where("false")


def rewrite(tmp_path, change):
    doc = json.loads((tmp_path / "m.json").read_text())
    change(doc)
    (tmp_path / "m.json").write_text(json.dumps(doc))


def test_bytes_that_are_no_text_are_left_out(spark):
    rng = random.Random(2)
    bits = [b"a", "é".encode(), "�".encode(), "".encode(), "a".encode(), "b".encode(), b"\xff", b"\xc3", b"\xe2\x82", "日".encode(), b"\xed\xa0\x80", b"\xf0\x9f\x98", b"\n"]
    rows = [(k, b"".join(rng.choices(bits, k=rng.randrange(9)))) for k in range(400)]
    got = spark.createDataFrame(rows, "k int, b binary").select("k", lenient(F.col("b")).alias("t")).collect()
    assert {r.k: r.t for r in got} == {k: b.decode("utf-8", "ignore") for k, b in rows}


def test_digests_go_in_order(spark):
    rng = random.Random(4)
    rows = [(f"g{k % 3}", [rng.choice("abc") for _ in range(rng.randrange(1, 4))], str(k)) for k in range(500)]
    want = {}
    for g in ("g0", "g1", "g2"):
        pieces = [p for _, p in sorted((o, p) for k, o, p in rows if k == g)]
        want[g] = pieces
    got = {r.g: r.sha256 for r in ordered_digests(spark.createDataFrame(rows, "g string, o array<string>, p string").repartition(9), "g", ["o", "p"], "p", "[", ", ", "]").collect()}
    for g, pieces in want.items():
        own = [p for _, p in sorted((tuple(o), p) for k, o, p in rows if k == g)]
        assert got[g] == hashlib.sha256(f"[{', '.join(own)}]".encode()).hexdigest()


def test_names_of_scans(spark, tmp_path):
    put(tmp_path / "one", {"a b.txt": "x\r\ny", "in/blank.txt": " \n", "in/ü.txt": b"z\xff", "n.MD": "no", "n.md": "# m"})
    put(tmp_path / "two", {"a.txt": "w"})
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    assert sorted(map(tuple, readers.text_files(spark, one).collect())) == [("a b.txt", "x\ny"), ("in/ü.txt", "z")]
    assert sorted(r.path for r in readers.text_files(spark, [one, two]).collect()) == ["one/a b.txt", "one/in/ü.txt", "two/a.txt"]
    assert sorted(r.path for r in readers.check_files(spark, [one, two + "/a.txt"]).collect()) == [f"{one}/a b.txt", f"{one}/in/blank.txt", f"{one}/in/ü.txt", f"{one}/n.md", f"{two}/a.txt"]
    for bad in (str(tmp_path / "none"), str(tmp_path)):
        put(tmp_path, {"only.py": ""})
        with pytest.raises(ValueError, match="no"):
            readers.check_files(spark, bad if bad != str(tmp_path) else str(tmp_path / "empty") if not (tmp_path / "empty").mkdir() else "")


def test_extension_files(spark, tmp_path):
    put(tmp_path, {"a.TXT": "one\n\ntwo", "b.md": "use `code`\n```\nx\n```\nend", "c.json": json.dumps({"z": {"text": "deep"}, "a": [{"text": "first"}, {"text": 3, "in": [{"text": "inner"}]}]}), "d.JSONL": '{"text": "l1"}\nnot json\n\n[{"text": "l3"}, {"text": "l4"}]\n', "e.py": "text"})
    got = {r.path.rpartition("/")[2]: r.text for r in readers.extension_files(spark, [str(tmp_path)], "blank").collect()}
    assert got == {"a.TXT#0": "one", "a.TXT#1": "two", "b.md#0": "use  ", "b.md#1": "end", "c.json#0": "first", "c.json#1": "inner", "c.json#2": "deep", "d.JSONL#0": "l1", "d.JSONL#1": "l3", "d.JSONL#2": "l4"}
    kept = {r.path.rpartition("/")[2]: r.text for r in readers.extension_files(spark, [str(tmp_path / "b.md")], "none", keep_code=True).collect()}
    assert "`code`" in kept["b.md#0"]


@pytest.mark.parametrize("change, message", [
    (lambda d: d.update(corpora=[]), "list of corpora"), (lambda d: d["corpora"].append(3), "corpus 9: not an object"), (lambda d: d["corpora"][1].update(label=d["corpora"][0]["label"]), "corpus 2: a label"),
    (lambda d: d["corpora"][0].update(surface="x"), "chat human: surface"), (lambda d: d["corpora"][0].update(exclude_rules=["W-M1", "W-M1"]), "exclude_rules"), (lambda d: d["corpora"][0].update(exclude_rules=["W-M10"]), "exclude_rules"),
    (lambda d: d["corpora"][0].update(path="gone"), "no folder"), (lambda d: d["corpora"][0].update(path=""), "a path"), (lambda d: d["corpora"].pop(0), "chat: no universal human"), (lambda d: [d["corpora"].pop(0), d["corpora"].pop(0)], "no corpus for chat"),
])
def test_errors_of_a_manifest(tmp_path, change, message):
    manifest(tmp_path)
    rewrite(tmp_path, change)
    with pytest.raises(ValueError, match=message):
        C.read_manifest(tmp_path / "m.json")


def test_scan_states_words_and_digests(spark, tmp_path):
    manifest(tmp_path)
    put(tmp_path / "corpora/chat ai", {"a-b/x.txt": "w", "a/z.txt": "it's so-so"})
    _, corpora = C.read_manifest(tmp_path / "m.json")
    _, rows = C.scan(spark, corpora)
    own = next(c for c in rows if c["label"] == "chat ai")
    names = ["a/z.txt", "a-b/x.txt", "a.txt", "b/c.txt"]  # by parts of the path, not by the whole
    hashes = [hashlib.sha256(n.encode() + b"\0" + (tmp_path / "corpora/chat ai" / n).read_bytes()).hexdigest() for n in names]
    assert own["sha256"] == hashlib.sha256(json.dumps(hashes).encode()).hexdigest()
    assert (own["docs"], own["words"]) == (4, 7 + 11 + 1 + 2)
    put(tmp_path / "corpora/chat ai", {"b/bad.txt": b"ok \xff"})
    with pytest.raises(ValueError, match="chat ai: b/bad.txt is not UTF-8"):
        C.scan(spark, corpora)
    put(tmp_path / "corpora/chat ai", {n: "—" for n in [*names, "b/bad.txt"]})
    with pytest.raises(ValueError, match="chat ai: no word"):
        C.scan(spark, corpora)


def test_a_run_is_published_and_reused(spark, tmp_path, parses):
    manifest(tmp_path)
    run, new = C.calibrate(spark, tmp_path / "m.json", str(tmp_path / "out"), None, *parses)
    assert len(new) == 8 and json.loads((tmp_path / "out" / C.RUN_FILE).read_text()) == run
    ai = next(c for c in run["corpora"] if c["label"] == "chat ai")
    assert len(ai["counts"]) == 22 and {r: n for r, n in ai["counts"].items() if n} == {"W-M1": 4, "W-M3": 2, "W-M4": 4, "W-M11": 1, "T-M5": 1}
    assert ai["per_1k"]["W-M1"] == round(4000 / ai["words"], 2)
    table = json.loads((tmp_path / "out/bands/chat.json").read_text())
    human = [c["per_1k"]["W-M4"] for c in run["corpora"] if (c["surface"], c["side"]) == ("chat", "human")]
    assert table["rules"]["W-M4"] == {"direction": "ai-high", "human_universal": [min(human), max(human)], "human_universal_n": 1, "ai_universal": round(statistics.median([ai["per_1k"]["W-M4"]]), 2), "ai_universal_n": 1}
    assert spark.read.parquet(str(tmp_path / "out/files")).count() == 16
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".calibration")]
    with pytest.raises(ValueError, match="there already"):
        C.calibrate(spark, tmp_path / "m.json", str(tmp_path / "out"), None, *parses)
    # One corpus changes: only it is counted anew, and the others keep their counts.
    put(tmp_path / "corpora/code human", {"a.txt": "We delve, delve and delve."})
    again, new = C.calibrate(spark, tmp_path / "m.json", str(tmp_path / "out2"), tmp_path / "out" / C.RUN_FILE, *parses)
    assert new == ["code human"]
    before, after = ({c["label"]: c["counts"] for c in r["corpora"]} for r in (run, again))
    assert after.pop("code human")["W-M4"] == 4 and before.pop("code human")["W-M4"] == 2 and before == after


@pytest.mark.parametrize("change, message", [
    (lambda d: d.update(format=2), "no complete run"), (lambda d: d["corpora"][0]["counts"].pop("W-M1"), "chat human: the run to reuse lacks"), (lambda d: d["corpora"][0]["counts"].update({"W-M1": -1}), "chat human: the run to reuse has no count for W-M1"),
    (lambda d: d["corpora"][0]["per_1k"].update({"W-M1": 77.0}), "chat human: the rate of W-M1"), (lambda d: d["corpora"][0]["per_1k"].update({"W-M1": float("nan")}), "chat human: the rate of W-M1"),
])
def test_a_run_that_cannot_be_right_is_refused(change, message):
    zero = dict.fromkeys(C.RULES, 0)
    corpus = {"label": "chat human", "docs": 1, "words": 10, "sha256": "d"}
    old = {"format": 1, "rules": C.RULES, "provenance": {"engine": {"e": "1"}}, "corpora": [{**corpus, "counts": dict(zero), "per_1k": dict.fromkeys(C.RULES, 0.0)}]}
    assert C.kept_counts(old, [corpus], {"e": "1"}) == {"chat human": zero}
    assert C.kept_counts(old, [corpus], {"e": "2"}) == {} == C.kept_counts(old, [{**corpus, "sha256": "e"}], {"e": "1"})
    change(old)
    with pytest.raises(ValueError, match=message):
        C.kept_counts(old, [corpus], {"e": "1"})


def test_groups_keep_a_corpus_for_every_rule(spark, tmp_path, parses):
    manifest(tmp_path)
    rewrite(tmp_path, lambda d: d["corpora"][1].update(exclude_rules=["T-M9"]))
    with pytest.raises(ValueError, match="chat: no universal ai corpus is left for T-M9"):
        C.calibrate(spark, tmp_path / "m.json", str(tmp_path / "out"), None, *parses)
    assert not (tmp_path / "out").exists() and not [p for p in tmp_path.iterdir() if p.name.startswith(".calibration")]


def test_the_command_says_what_is_wrong(spark, tmp_path, capsys):
    manifest(tmp_path)
    put(tmp_path / "out", {"x": ""})
    assert cli.main(["calibrate", "--manifest", str(tmp_path / "m.json"), "--output", str(tmp_path / "out")]) == 2
    assert "there already" in capsys.readouterr().err
    if not P.available():
        assert cli.main(["calibrate", "--manifest", str(tmp_path / "m.json"), "--output", str(tmp_path / "new")]) == 2
        assert "spaCy is not installed" in capsys.readouterr().err
    assert cli.main(["calibrate", "--manifest", str(tmp_path / "none.json"), "--output", str(tmp_path / "new")]) == 2
