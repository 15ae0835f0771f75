"""A source whose first document is far over its target: as the SQL says."""

import duckdb
import pytest

pytest.importorskip("prosegrain.llm")
from prosegrain.llm import mixing
from prosegrain.llm.queries import ORACLE


def test_one_document_of_most_words(spark, tmp_path):
    rows = [(1, "a " * 300, "A"), (2, "b", "B")] + [(10 + k, "c " * 9, "C") for k in range(11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.taken for r in mixing.fair_mix(docs).collect()}
    docs.write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    assert got == dict(con.execute(f"SELECT doc_id, taken FROM ({ORACLE['op9_mixing']})").fetchall())
    assert got[1] == 0 and sum(got.values()) <= 400
