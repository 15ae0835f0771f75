"""Parse rules look at one sentence in its row: no sentence's text stands on every token, and sentences are not shuffled."""

import pytest
from pyspark.sql import functions as F

from prosegrain.operators import parse_rules as P
from prosegrain.plans import parse_samples as PS
from prosegrain.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_text_of_a_sentence_is_there_once(spark):
    docs = spark.createDataFrame([(1, "a " * 3000), (2, "One two.\nThree! "), (3, None)], "doc_id long, text string")
    rows = PS.token_table(docs)
    assert rows.agg(F.sum(F.length("sent_text"))).first()[0] < 3 * 6000
    assert [tuple(r) for r in rows.where("path = '2'").select("sent", "i", "line", "text_line", "is_punct").orderBy("i").collect()] == [
        (0, 0, 1, 1, False), (0, 1, 1, 1, False), (0, 2, 1, 1, True), (1, 3, 1, 1, False), (1, 4, 2, 1, False), (1, 5, 2, 1, True)]


@pytest.mark.parametrize("rule", ["T-M1", "T-M2", "T-M4", "T-M5", "W-M11", "T-M10"])
def test_rows_and_tokens_tell_the_same(spark, rule):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    check = P.non_imperative if rule == "T-M10" else P.PARSE_RULES[rule]
    asked = PS.item_table if rule == "T-M10" else lambda t: t
    by_row, by_token = check(asked(PS.sentence_table(docs))), check(asked(PS.token_table(docs)))
    assert sorted(map(str, by_row.collect())) == sorted(map(str, by_token.collect())) and by_row.count() > 3
    query = plan(QUERIES[f"rule_{rule.lower().replace('-', '_')}"](spark, DIR))
    assert not any(word in query for word in ("Window", "Join", "Aggregate"))
