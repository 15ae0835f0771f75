"""Terms go to the vocabulary in blocks, and a bit comes back; no row of a unit's term is dealt out."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prosegrain.functions import grams as G
from prosegrain.functions import text as T
from prosegrain.operators import terms as TM
from prosegrain.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def joins(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Join ") - plan.count("Join Cross")  # statistics, one row, are joined crosswise


@pytest.mark.parametrize(("name", "most"), [("sentence_report", 2), ("score_sentences", 2), ("rule_w_m10", 2)])
def test_the_vocabulary_is_not_joined_with_rows_of_terms(spark, name, most):
    """Every term of every unit was shuffled and sorted for the vocabulary as soon as that was too large to be broadcast.
    What is left: jargon, and a join by unit."""
    assert joins(spark, name) <= most


def test_a_large_vocabulary_deals_out_no_rows_of_terms(spark):
    """``unapproved_bigrams`` with a vocabulary that is not broadcast; jargon still is."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        plan = QUERIES["unapproved_bigrams"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_digests_of_phrases_are_those_of_their_text():
    tokens = pa.array([["ab", "", "été", "ab", "of", "c" * 300], [], ["ab", "x"]])
    for f in G.distinct(tokens, (1, 2, 3)):
        assert (G.digests(f.terms.slice(1))[0] == f.digest[1:]).all()
    assert len(G.digests(pa.array([], pa.string()))[0]) == 0


def test_blocks_hold_terms_and_numbers():
    terms = pa.array([f"w{k}" for k in range(5000)] + ["é", ""])
    numbers = np.arange(2 * len(terms)).reshape(2, -1)
    got = {}
    for bucket, block in G.blocks(terms, G.digests(terms)[0], numbers):
        part, own = G.unpack(block, 2)
        assert 0 <= bucket < G.BUCKETS
        got |= dict(zip(part.to_pylist(), own.T.tolist()))
    assert got == dict(zip(terms.to_pylist(), numbers.T.tolist()))


@pytest.mark.parametrize("most", [1, 60, 10**6])
def test_known_terms_as_by_loops(spark, most, monkeypatch):
    monkeypatch.setattr(TM, "LOOKED_UP", most)
    monkeypatch.setattr(TM, "LOT", most)
    rng = random.Random(5)
    words = ["the", "alpha", "beta", "gamma-x", "it's", "d4", "of"]
    lists = [rng.choices(words, k=rng.randrange(0, 12)) for _ in range(60)] + [[], ["the"]]
    units = spark.createDataFrame([(k, None if k == 7 else k // 2, x) for k, x in enumerate(lists)], "at int, unit int, tokens array<string>")
    laid = TM.in_lots(units)
    assert TM.in_lots(laid) is laid
    for known in ([], ["alpha", "alpha", "beta the", "beta alpha", "zzz", None]):
        rows = TM.known_terms(laid, spark.createDataFrame([(x,) for x in known], "term string")).collect()
        counts = units.select("at", "unit", F.explode(T.grams(F.col("tokens"))).alias("term")).groupBy("at", "unit", "term").count().collect()
        want = sorted((str(r.unit), r.term, r["count"], r.term in known) for r in counts)
        assert sorted((str(r.unit), r.term, r.n, r.is_known) for r in rows) == want
    base = sorted((str(r.unit), r.tokens, r.content_words) for r in TM.lengths_of(laid).collect())
    assert base == sorted((str(None if k == 7 else k // 2), len(x), sum(w not in T.STOPWORDS for w in x)) for k, x in enumerate(lists))


@pytest.mark.parametrize("most", [1, 30, 10**6])
def test_counts_of_lots_are_those_of_tokens(spark, most, monkeypatch):
    monkeypatch.setattr(TM, "LOOKED_UP", most)
    rng = random.Random(6)
    rows = [(k, rng.choice(["approved", "contrast", None]), rng.choices(["alpha", "of", "beta", "c3"], k=rng.randrange(0, 9))) for k in range(50)]
    corpus = spark.createDataFrame(rows, "unit int, side string, tokens array<string>")
    laid = TM.in_lots(corpus)
    assert sorted(TM.term_counts(laid).collect()) == sorted(TM.term_counts(corpus).collect())
    assert sorted(TM.corpus_stats(laid).collect(), key=str) == sorted(TM.corpus_stats(corpus).collect(), key=str)
