"""Rules of any number and length, and expressions of alternatives only."""

import random
import re
import string

import pytest

pytest.importorskip("prosegrain.llm")
from prosegrain.llm.secret_scan import Rule, secret_scan
from prosegrain.llm.trigram_query import trigram_query


def scan(spark, texts, rules):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return {r.doc_id: [(x.kind, x.start, x.stop) for x in r.found] for r in secret_scan(docs, rules=tuple(rules)).collect()}


@pytest.mark.parametrize("size", [61, 62, 63, 64, 65, 90, 200])
def test_a_rule_of_many_clauses(spark, size):
    rng = random.Random(size)
    literal = "".join(rng.choices(string.ascii_letters, k=size + 2))
    assert len(trigram_query(literal)) >= size - 3
    near = literal[:-1] + ("z" if literal[-1] != "z" else "y")
    got = scan(spark, [f"a {literal} b", f"a {near} b", literal.swapcase(), None], [Rule("long", literal)])
    assert got == {0: [("long", 2, 2 + len(literal))], 1: [], 2: [], 3: []}


def test_a_hundred_and_thirty_rules(spark):
    rules = [Rule(f"r{k}", f"key{k}q[0-9]+") for k in range(130)] + [Rule("free", "[#]+")]
    texts = [f"x key{k}q{k} y #" for k in range(130)] + ["key7q key61q1 key62q2 key129q3"]
    got = scan(spark, texts, rules)
    for k in range(130):
        start = 2
        assert got[k] == [(f"r{k}", start, start + len(f"key{k}q{k}")), ("free", len(texts[k]) - 1, len(texts[k]))]
    assert [x[0] for x in got[130]] == ["r61", "r62", "r129"]


@pytest.mark.parametrize("regex, wanted", [("akia|asia", {"aki", "asi"}), ("(?:akia|asia)", {"aki", "asi"}), ("abc|abcd|xabc", None), ("ab|abc", None)])
def test_alternatives_of_strings_have_a_query(regex, wanted):
    query = trigram_query(regex)
    assert bool(query) == (min(map(len, re.sub(r"\(\?:|\)", "", regex).split("|"))) >= 3)
    for word in re.sub(r"\(\?:|\)", "", regex).split("|"):
        assert all(any(t in word for t in clause) for clause in query)
    if wanted:
        assert frozenset(wanted) in query
