"""Unwrapping against a plain walk over the lines, and in time that grows with the lines."""

import random
import re
import time

from pyspark.sql import functions as F

from prosegrain.functions.blocks import unwrap

FENCE, LIST = re.compile(r"\s*(```|~~~)"), re.compile(r"\s*([-*+]|\d+\.) ")
ALONE = re.compile(r"\s*$|#{1,6} |\s*([-*+]|\d+\.) |\s*\||\s*>|\s*[-=]{3,}\s*$|<")
LINES = ["a line", "  more of it  ", "", "   ", "# Head", "#", "##  ", "- item", "  * item ", "12. item", "-", "1.", "| a | b |", "> quoted", "---", "  ====  ", "==", "<div>", "```", "~~~ x", "---", "ünï ", "- ", "***"]


def plain(text: str) -> str:
    """Each line takes the lines that go on from it, one by one, until one does not."""
    lines, out, k = text.splitlines(), [], 0
    if lines and lines[0].strip() == "---" and "---" in lines[1:]:
        k = lines[1:].index("---") + 2
        out = lines[:k]
    while k < len(lines):
        if FENCE.match(lines[k]):
            stop = next((j for j in range(k + 1, len(lines)) if FENCE.match(lines[j])), len(lines) - 1)
            out += lines[k : stop + 1]
            k = stop + 1
            continue
        whole, k = lines[k], k + 1
        while k < len(lines) and not ALONE.match(lines[k]) and not FENCE.match(lines[k]) and whole and (LIST.match(whole) or not ALONE.match(whole)):
            whole, k = f"{whole.rstrip()} {lines[k].strip()}", k + 1
        out.append(whole)
    return "\n".join(out) + "\n" * text.endswith("\n")


def test_unwrap_is_the_plain_walk(spark):
    rng = random.Random(3)
    texts = ["", "\n", "one", "one\n", "\n\n\n", "---\na: 1\nb: 2\n---\nx\ny", "---\nnever\nclosed", "a\r\nb c\x0bd\x85e\n"]
    texts += [rng.choice(["\n", "\n", "\r\n"]).join(rng.choices(LINES, k=rng.randrange(1, 25))) + rng.choice(["", "\n"]) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate([*texts, None])), "k int, t string")
    got = {r.k: r.u for r in rows.select("k", unwrap(F.col("t")).alias("u")).collect()}
    assert got.pop(len(texts)) is None
    for k, t in enumerate(texts):
        assert got[k] == plain(t), t
    again = spark.createDataFrame(list(got.items()), "k int, t string").select("k", "t", unwrap(F.col("t")).alias("u"))
    plain_ones = [r for r in again.collect() if not any(c in r.t for c in "#`~")]  # two signs in a row make new headings and fences
    assert plain_ones and all(r.u == plain(r.t) for r in plain_ones)


def test_a_paragraph_of_200_000_lines(spark):
    text = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda k: F.concat(F.lit("  line "), k.cast("string"))), "\n").alias("t"))
    began = time.time()
    r = text.select(unwrap(F.col("t")).alias("u")).select(F.length("u").alias("n"), F.contains(F.col("u"), F.lit("\n")).alias("two"), F.substring("u", 1, 30).alias("head")).first()
    assert not r.two and r.head == "  line 1 line 2 line 3 line 4 " and r.n == 2 + sum(6 + len(str(k)) for k in range(1, 200_001)) - 1
    assert time.time() - began < 60
