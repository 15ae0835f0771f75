"""Terms counted by lots as numbers are those of the Column expressions."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prosegrain.functions import grams as G
from prosegrain.functions import text as T
from prosegrain.operators import lexicon as L
from prosegrain.operators import score as S
from prosegrain.operators import terms as TM
from prosegrain.plans.queries import QUERIES

WORDS = ["the", "of", "alpha", "beta", "gamma-x", "it's", "d4", "é"]


@pytest.fixture(scope="module")
def lists():
    rng = random.Random(3)
    return [rng.choices(WORDS, k=rng.randrange(0, 40)) for _ in range(200)] + [[], None, ["alpha"], ["the"]]


@pytest.mark.parametrize("lot", [1, 100, 10**6])
def test_terms_are_those_of_the_columns(spark, lists, lot, monkeypatch):
    monkeypatch.setattr(G, "LOT", lot)
    tokens = pa.array(lists, pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lists))), tokens], ["unit", "tokens"]).slice(1)
    got = Counter()
    for part in G.lots([batch]):
        for f in G.distinct(part.column("tokens"), (1, 2, 3)):
            for r, w, n in zip(f.row, f.which, f.n):
                got[part.column("unit")[int(r)].as_py(), f.terms[int(w)].as_py()] += int(n)
    rows = spark.createDataFrame(list(enumerate(lists)), "unit int, tokens array<string>").where("unit > 0")
    want = {(r.unit, r.term): r["n"] for r in rows.select("unit", F.explode(T.grams(F.col("tokens"))).alias("term")).groupBy("unit", "term").agg(F.count("*").alias("n")).collect()}
    assert got == want and len(want) > 1000


def test_many_words_in_a_lot():
    """Codes of three words of so large a vocabulary do not fit 62 bits."""
    n = 1_700_000
    tokens = pa.array([[f"w{k}" for k in range(n)] + ["w0", "w1", "w2"]])
    (f,) = G.distinct(tokens, (3,))
    assert len(f.terms) == n + 0 and sorted(f.n)[-2:] == [1, 2] and f.terms[int(f.which[f.n.argmax()])].as_py() == "w0 w1 w2"


def test_phrases_that_are_no_jargon_have_no_row(spark):
    """They were joined and dealt out, and nothing reads them."""
    docs = spark.createDataFrame([(k, "approved" if k % 2 else "contrast", ["alpha", "beta", f"word{k}"]) for k in range(40)], "doc_id int, side string, tokens array<string>")
    lex = L.build(docs)
    hits = S.term_hits(docs.select(F.col("doc_id").alias("unit"), "tokens"), lex)
    assert hits.where("size > 2 AND class IS NULL").count() == 0 and hits.where("size < 3").count() == 40 * 5


def test_documents_are_dealt_to_all_tasks(spark):
    """The table is one row group, which one task reads; it did all work in the row."""
    plan = QUERIES["keyness_g2"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan
    assert TM.term_counts(spark.createDataFrame([], "doc_id int, side string, tokens array<string>")).count() == 0
