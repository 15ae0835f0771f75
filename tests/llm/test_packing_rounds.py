import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("prosegrain.llm")
from prosegrain.llm import packing


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 40), max_size=9), st.integers(0, 4)), min_size=1, max_size=8))
def test_matches_between_ranges_never_overfill_a_gap(drawn):
    """Ranges of ascending sizes: documents, largest first, and gaps, smallest first."""
    low, ranges = 0, []
    for sizes, n_gaps in drawn:
        items = sorted((low + s for s in sizes), reverse=True)
        top = items[0] if items else low
        ranges.append((items, [top + 3 * k for k in range(n_gaps)] if top else []))
        low = max([top, *ranges[-1][1]])
    parts = [(k, len(i), i[0] if i else None, len(g), g[0] if g else None) for k, (i, g) in enumerate(ranges)]
    room = {(k, r): size for k, (_, gaps) in enumerate(ranges) for r, size in enumerate(gaps)}
    matched = set()
    for of, first, n, to, at, each in packing.successors(parts):
        assert of < to and n > 0
        for q in range(n):
            assert (of, first + q) not in matched
            matched.add((of, first + q))
            room[to, at + q // each] -= ranges[of][0][first + q]
    assert all(r >= 0 for r in room.values())
    below = 0
    for k, (items, gaps) in enumerate(ranges):  # a gap over documents is never left when there are documents below it
        if below and gaps:
            assert matched
        below += len(items)


def test_spare_room_goes_to_the_next_lower_range():
    parts = [(0, 3, 10, 0, None), (1, 2, 20, 0, None), (2, 0, None, 1, 100)]
    assert packing.successors(parts) == [(1, 0, 2, 2, 0, 5), (0, 0, 3, 2, 0, 6)]


def test_rounds_are_few_however_many_ranges(spark, monkeypatch):
    """What is left at the end is small documents in many ranges and few gaps."""
    from pyspark.sql import functions as F

    rounds = []
    monkeypatch.setattr(packing, "crossed", lambda *a, f=packing.crossed: rounds.append(1) or f(*a))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("the "), (3 + F.col("id") % 37).cast("int")).alias("text"))
    out = packing.pack(docs, 512, ranges=16).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    words = sum(r.n for r in out)
    assert words == sum(4 + k % 37 for k in range(300)) and max(r.n for r in out) <= 512
    assert len(out) <= -(-words // 512) + 1 and len(rounds) <= 12
