import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("prosegrain.llm")
from prosegrain.llm import jaccard_join as J
from prosegrain.llm.components import components

U = np.uint64


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, percent=80):
    """id -> smallest id of its class"""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", "n") for i, t in rows], "doc_id long, text string, key string, node string")


def check(spark, rows, **options):
    got = {r.doc_id: r for r in J.jaccard_classes(frame(spark, rows).repartition(3), **options).collect()}
    classes, sizes = brute(rows)
    assert {i: r.component_id for i, r in got.items()} == classes
    assert {i: r.n_shingles for i, r in got.items()} == sizes


def family(rng, base, copies, edits):
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_families_chains_and_passages(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = [None, "", " \n\t", "One", "one", "a b c d", "A  b\x0bc d", "x y", "a b c d e", "é É ß"]
    for size, copies, edits in ((40, 40, 4), (150, 30, 8), (600, 8, 20), (12, 10, 1)):
        texts += family(rng, [word() for _ in range(size)], copies, edits)
    passage = " ".join(word() for _ in range(60))
    texts += [passage + " " + " ".join(word() for _ in range(rng.randrange(5, 120))) for _ in range(40)]
    chain = [word() for _ in range(200)]
    for k in range(25):  # each is near the next, the ends are not
        chain = chain[6:] + [word() for _ in range(6)]
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    check(spark, list(enumerate(texts)))


def test_groups_larger_than_a_block_and_keys_that_are_not_held(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = family(rng, [word() for _ in range(60)], 60, 6) + family(rng, [word() for _ in range(150)], 30, 14)
    shared = [word() for _ in range(70)]  # long enough to share keys, too short to be similar
    texts += [" ".join(shared + [word() for _ in range(rng.randrange(15, 40))]) for _ in range(40)]
    rng.shuffle(texts)
    check(spark, list(enumerate(texts)), block=7, most=16)


def test_runs_keep_rows_of_a_key_together_and_long_ones_come_in_parts():
    import pyarrow as pa

    keys = [1, 1, 2, 3, 3, 3, 3, 3, 3, 3, 4, 5, 5, 5, 6]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[k : k + 2]), pa.array(list(range(k, min(k + 2, len(keys)))))], ["key", "at"]) for k in range(0, len(keys), 2)]
    whole = list(J.in_runs(iter(batches)))
    assert [x for _, b, _ in whole for x in b.column(1).to_pylist()] == list(range(len(keys)))
    tables_of = {k: sum(k in b.column(0).to_pylist() for _, b, _ in whole) for k in set(keys)}
    assert set(tables_of.values()) == {1} and all(long is None for *_, long in whole)
    parts = list(J.in_runs(iter(batches), 4))
    assert [x for _, b, _ in parts for x in b.column(1).to_pylist()] == list(range(len(keys)))
    assert {long for _, b, long in parts if 3 in b.column(0).to_pylist()} == {3}
    assert all(sum(1 for _, b, _ in parts if k in b.column(0).to_pylist()) == 1 for k in (1, 2, 4, 6))


def test_a_pair_of_blocks_meets_once(spark):
    left = spark.createDataFrame([(g, m, 100 * g + k, k, 50, b"x" * 8) for g, m in ((1, 23), (2, 3)) for k in range(m)], "group long, m long, node long, class long, n long, sketch binary")
    lots = {}
    for r in J.in_blocks(left, 5).collect():
        lots.setdefault((r.group, r.low, r.high), []).append((r.first, r.node))
    met = []
    for (_, low, high), nodes in lots.items():
        a, b = [x for f, x in nodes if f], [x for f, x in nodes if not f]
        assert low != high or not b
        met += [tuple(sorted((x, y))) for x in a for y in b] if low != high else [(x, y) for x in a for y in a if x < y]
    assert sorted(met) == sorted((100 * g + x, 100 * g + y) for g, m in ((1, 23), (2, 3)) for x in range(m) for y in range(x + 1, m))


def test_cases(spark):
    assert J.jaccard_classes(frame(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, None), (9, "")]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in J.jaccard_classes(frame(spark, rows)).collect())
    assert got == [(-1, 0, -1), (-1, 2, 7), (7, 2, 7), (7, 2, 7), (9, 0, 9)]
    kept = J.drop_near_copies(frame(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept if r.text) == [(7, "a b c d e f")] and len(kept) == 3
    assert set(kept[0].asDict()) == {"doc_id", "text", "key", "node"}


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10**6), st.integers(1, 120))
def test_similar_sets_share_a_key_and_pass_the_sketch(n, seed, swaps):
    rng = np.random.default_rng(seed)
    bands = J.Bands(80)
    a = rng.integers(0, 1 << 63, n, dtype=np.int64).astype(U)
    b = a.copy()
    k = min(swaps, n)
    kind = rng.integers(0, 3)
    if kind == 0:
        b = b[k:]
    elif kind == 1:
        b = np.concatenate([b, rng.integers(0, 1 << 63, k, dtype=np.int64).astype(U)])
    else:
        b[:k] = rng.integers(0, 1 << 63, k, dtype=np.int64).astype(U)
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b))
    if not len(b) or 100 * both < 80 * (len(a) + len(b) - both) or np.array_equal(a, b):
        return
    keys = lambda u: {int(x) for band in bands.of(len(u)) for x in J.keys(u, band, bands)}
    assert keys(a) & keys(b)
    x, y = J.sketch(a, bands.bits(len(a))), J.sketch(b, bands.bits(len(b)))
    size = min(len(x), len(y))
    assert int(J.hamming(J.folded(x, size), J.folded(y, size))) <= bands.differ(len(a) + len(b))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abA \n\t\x0b\x1cé", max_size=30), max_size=6))
def test_shingles_match_words(texts):
    found = J.shingle_sets([t.encode() for t in texts], 2) if texts else []
    assert [len(u) for u in found] == [len(shingles(t, 2)) for t in texts]
    names = {}
    for t, u in zip(texts, found):
        assert names.setdefault(shingles(t, 2), u.tobytes()) == u.tobytes()


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5)] + [(100 + k, 101 + k) for k in range(40)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert {got[x] for x in (1, 2, 3)} == {1} and {got[x] for x in (7, 8, 9)} == {7} and {got[100 + k] for k in range(41)} == {100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
