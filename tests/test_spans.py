"""Places of matches against Python's, for few and for many matches in a text."""

import re

from pyspark.sql import functions as F

from prosegrain.functions import spans


def test_places(spark):
    texts = ["", None, "X", "no match", "aXbb\nXX c\n\nX", "é\U0001f600X\r\nX" * 3, "aX\nXX " * 31, "aX\nXX " * 32, "aX\nXX " * 500, "X" * 1000]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, found in frame.select("t", spans.find_all(F.col("t"), "X+")).collect():
        want = [(m.start(), m.end(), t.count("\n", 0, m.start()) + 1, m.group()) for m in re.finditer("X+", t or "")]
        assert [tuple(x) for x in found] == want


def test_running_sums(spark):
    for n in (0, 1, 2, 3, 4, 5, 8, 9, 100, 1025):
        got = spark.range(1).select(spans.running(F.slice(F.sequence(F.lit(1), F.lit(n + 1)), 1, n))).head()[0]
        assert got == [k * (k + 1) // 2 for k in range(1, n + 1)]
