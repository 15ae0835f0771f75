import pytest
from pyspark.sql import functions as F

from prosegrain.functions import blocks, spans, text as T
from prosegrain.operators import bands as B
from prosegrain.operators import rules as R


def found(spark, text, *rules, **kw):
    docs = spark.createDataFrame([("a.md", text)], "path string, text string")
    return [tuple(r) for r in R.sort_findings(R.check(docs, list(rules), **kw)).select("line", "rule", "label", "match", "fix").collect()]


def test_dashes(spark):
    assert found(spark, "One — two.", "W-M1") == [(1, "W-M1", "em dash", "One — two.", None)]
    assert found(spark, "2024–2026 and 1,000 – 2", "W-M1") == []
    assert [f[2] for f in found(spark, "here – there", "W-M1")] == ["en dash"]
    assert found(spark, "`a — b`\n\n```\nc — d\n```", "W-M1") == []
    assert [f[0] for f in found(spark, "```\nx — y\n```\nplain\nz — w", "W-M1")] == [5]
    assert [f[0] for f in found(spark, "a — b\n\nc — d", "W-M1")] == [1, 3]


def test_snippet_ends_on_words(spark):
    (f,) = found(spark, "Considerable enlargement was — incomprehensibly so", "W-M1")
    assert f[3] == "enlargement was —" or f[3].startswith("enlargement was —")


def test_word_boundaries_know_letters(spark):
    assert found(spark, "éunlock unlocké unlock", "W-M4") == [(1, "W-M4", "register word", "unlock", None)]


def test_unclosed_fence_runs_to_the_end(spark):
    assert found(spark, "~~~\nrobust", "W-M4") == []
    assert found(spark, "```a\nx```robust", "W-M4") == [(2, "W-M4", "register word", "robust", None)]


def test_fixes_and_overlaps(spark):
    both = found(spark, "We utilize it.", "W-M4", "T-M8")
    assert [(f[1], f[4]) for f in both] == [("T-M8", "use"), ("W-M4", None)]
    assert found(spark, "ask evo-B-Gate", "P-M1")[0][4] == "b-gate"


def test_input_contract(spark):
    assert [f[3] for f in found(spark, "text", "P-M5", fields={"surface": "chat", "intent": " "})] == ["audience", "channel_id", "destination_type", "intent"]


def test_late_condition_and_items(spark):
    assert found(spark, "Press the key. Open it now, if it rings.", "T-M11")[0][3] == "Open it now, if"
    assert found(spark, "1. a; b\n2. stop;\n- x and then y", "T-M12") == [(1, "T-M12", "two actions in one item", "a; b", None)]


def test_sort_compares_rules_as_text(spark):
    rows = [("a", 1, "T-M2", "l", "m", None), ("a", 1, "T-M10", "l", "m", None)]
    df = spark.createDataFrame(rows, "path string, line int, rule string, label string, match string, fix string")
    assert [r.rule for r in R.sort_findings(df).collect()] == ["T-M10", "T-M2"]


def test_select():
    run, skipped = R.select()
    assert run == ["W-M1", "W-M2", "W-M3", "W-M4", "W-M6", "W-M7", "W-M8", "W-M9"] and skipped == ["W-M10"]
    assert "T-M10" in R.select("technical")[1]
    assert R.select("T-M10,T-M3", have_parser=True)[0] == ["T-M3", "T-M10"]
    with pytest.raises(ValueError):
        R.select(["W-M99"])


def test_line_format(spark):
    df = spark.createDataFrame([("p", 2, "T-M8", "unapproved word", "utilize", "use"), ("p", 1, "W-M1", "em dash", "a — b", None)], "path string, line int, rule string, label string, match string, fix string")
    assert [r.value for r in R.finding_line(df).collect()] == ['p:2: [T-M8] unapproved word: "utilize" for "use"', 'p:1: [W-M1] em dash: "a — b"']


def test_blanking_keeps_length(spark):
    texts = ["", "x", "```\na\nb", "a `b` c ``d``", "~~~\n~~~ x `q`", "# h\n| a |\n- i\n===\n1) x", "é🎉 `🎉🎉`\n```🎉\n```"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", spans.strip_code(F.col("t")).alias("c"), spans.strip_markup(F.col("t")).alias("m")).collect():
        assert len(r.c) == len(r.m) == len(r.t)
        assert r.c.count("\n") == r.m.count("\n") == r.t.count("\n")


def test_find_all(spark):
    (r,) = spark.createDataFrame([("🎉ab\nab",)], "t string").select(spans.find_all(F.col("t"), "ab").alias("m")).collect()
    assert [tuple(x) for x in r.m] == [(1, 3, 1, "ab"), (4, 6, 2, "ab")]


def test_paragraphs_and_items(spark):
    text = "One\n two\n\n# head\nmore\n\nlast"
    (r,) = spark.createDataFrame([(text,)], "t string").select(blocks.paragraphs(F.col("t")).alias("p"), blocks.list_items(F.lit("- a\n2) b \n3.\n* ")).alias("i")).collect()
    assert [tuple(x) for x in r.p] == [(1, "One two"), (7, "last")]
    assert [tuple(x) for x in r.i] == [(1, False, "a"), (2, True, "b")]


def test_unwrap(spark):
    text = "---\na: 1\nb: 2\n---\n# Head\nOne\ntwo\n\n- item\n  goes on\n- next\n```\nx\ny\n```\n| a |\n| b |\n"
    want = "---\na: 1\nb: 2\n---\n# Head\nOne two\n\n- item goes on\n- next\n```\nx\ny\n```\n| a |\n| b |\n"
    df = spark.createDataFrame([(text,), (want,)], "t string")
    assert [r.u for r in df.select(blocks.unwrap(F.col("t")).alias("u")).collect()] == [want, want]


def test_tokens(spark):
    (r,) = spark.createDataFrame([("I'm A b :smile: Well-known it's x9 9x É",)], "t string").select(T.tokenize(F.col("t")).alias("t"), T.number_text(F.lit(0.5)).alias("n")).collect()
    assert r.t == ["i'm", "well-known", "it's", "x9"] and r.n == "0.5"


def test_positions(spark):
    bands = spark.createDataFrame([("b", r, d, lo, hi, None, None, ai, None) for r, d, lo, hi, ai in [("A", "ai-high", 0.0, 0.0, 0.0), ("B", "ai-high", 0.0, 1.0, 9.0), ("C", "human-high", 0.0, 1.0, 0.0), ("D", "ai-high", 0.0, 9.0, 99.0), ("W-M1", "ai-high", 0.0, 1.0, 2.0), ("E", "ai-high", None, None, 1.0)]], B.BANDS)
    counts = spark.createDataFrame([("A", 0), ("B", 2), ("C", 2), ("D", 3), ("E", 1)], "rule string, findings long")
    words = spark.createDataFrame([(1000,)], "words long")
    got = {r.rule: (r.status, r.position) for r in B.verdicts(counts, words, bands).collect()}
    assert got == {"A": ("FAIL", "ai-range"), "B": ("WARN", "elevated above human band"), "C": ("FAIL", "above human range (style)"), "D": ("PASS", "human-band"), "W-M1": ("PASS", "human-band"), "E": ("-", "no band")}
    assert B.verdicts(counts, spark.createDataFrame([(299,)], "words long"), bands).count() == 0


def test_calibration(spark):
    corpora = spark.createDataFrame([("h", "chat", "human", "universal"), ("a", "chat", "ai", "universal"), ("x", "chat", "human", "universal")], "label string, surface string, side string, origin string")
    words = spark.createDataFrame([("h", 5), ("a", 7), ("x", 10)], "label string, words long")
    hits = spark.createDataFrame([("a", "W-M1"), ("x", "W-M1")], "label string, rule string")
    rates = B.calibration_rates(corpora, words, hits, ["W-M1"])
    left_out = spark.createDataFrame([("x", "W-M1")], "label string, rule string")
    (r,) = B.calibrate(corpora, rates, left_out).collect()
    assert (r.human_universal_lo, r.human_universal_hi, r.human_universal_n, r.ai_universal, r.ai_universal_n) == (0.0, 0.0, 1, 142.86, 1)
    with pytest.raises(ValueError):
        B.check_groups(B.calibrate(corpora, rates, spark.createDataFrame([("h", "W-M1"), ("x", "W-M1")], "label string, rule string")))
