"""Sentence starts and items of the parse stage against plain walks over texts."""

import random
import re

from pyspark.sql import functions as F

from prosegrain.operators import parse_rules as P

LINES = ["One two.", "  - an item here", "12) another item", "* ", "# A head", "", "   ", "more of it", "| a | b |", "```\ncode — here\n```", "`x` and so", "\t+ tabbed item"]


def test_starts_are_the_plain_ones(spark):
    rng = random.Random(5)
    texts = ["", "\n\n", "word", "\n\nfirst"] + ["\n".join(rng.choices(LINES, k=rng.randrange(1, 9))) for _ in range(300)]
    docs = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "path string, text string")
    bodies = docs.select("path", P.strip_code(F.col("text")).alias("coded"), P.strip_markup(P.strip_code(F.col("text"))).alias("body")).collect()
    rows, want = [], set()
    for r in bodies:
        items = {m.start(1) for m in re.finditer(r"(?m)^[ \t]*(?:[-*+]|\d+[.)])[ \t]+(\S[^\n]*)$", r.coded)}
        end = 0
        for i, m in enumerate(re.finditer(r"\s+|\S+", r.body)):
            rows.append((r.path, i, m.start(), m[0], m[0].isspace()))
            if m[0].isspace():
                continue
            if end and (m.start() in items or re.search(r"\n[ \t]*\n", r.body[end : m.start()])):
                want.add((r.path, i))
            end = m.end()
    tokens = spark.createDataFrame(rows, "path string, i int, idx int, text string, is_space boolean")
    assert {(r.path, r.i) for r in P.sentence_starts(tokens, P.breaks(docs)).collect()} == want and len(want) > 100


def test_items_are_texts_of_their_own(spark):
    docs = spark.createDataFrame([("p", "- You should go\ntext\n1. `x` open it\n```\n- no\n```\n-  \n"), ("q", None)], "path string, text string")
    assert [(r.path, r.line, r.body.split()[-1]) for r in P.item_texts(docs).orderBy("line").collect()] == [("p", 1, "go"), ("p", 3, "it")]
