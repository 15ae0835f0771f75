"""Running sums by blocks: the same as plain ones at every edge of a block, and few enough visits of an element."""

from itertools import accumulate

from pyspark.sql import functions as F

from prosegrain.functions import spans


def test_sums_at_the_edges_of_blocks(spark):
    lists = [[(7 * k * k + n) % 23 - 5 for k in range(n)] for n in (*range(35), 255, 256, 257, 5000)]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(lists)], "k int, v array<int>").select("k", spans.running(F.col("v")).alias("s")).collect()
    assert {r.k: r.s for r in rows} == {k: list(accumulate(v)) for k, v in enumerate(lists)}


def test_only_totals_of_blocks_are_doubled(spark, monkeypatch):
    """Every element took part in each of the doubling steps."""
    seen = []
    doubled = spans._doubled
    monkeypatch.setattr(spans, "_doubled", lambda v: seen.append(v) or doubled(v))
    df = spark.createDataFrame([([1] * 1000,)], "v array<int>")
    assert df.select(spans.running(F.col("v")).alias("s")).first().s[-1] == 1000 and len(seen) == 1


def test_places_without_lines(spark):
    texts = ["", "a\nb c", "one\n\ntwo " * 100]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for regex in (r"\S+", r"\n+"):
        both = df.select(spans.find_all(F.col("text"), regex).alias("a"), spans.find_all(F.col("text"), regex, lined=False).alias("b")).collect()
        assert all([(x.start, x.stop, x.hit) for x in r.a] == [(x.start, x.stop, x.hit) for x in r.b] and all(x.line is None for x in r.b) for r in both)
