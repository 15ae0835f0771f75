"""Sharding against a plain greedy, a group at a time."""

from collections import defaultdict

import pytest

pytest.importorskip("prosegrain.llm")
from prosegrain.llm import sharding


def plain(texts, shards):
    """Loads of the shards, as (bytes, tokens, rows)."""
    groups = defaultdict(lambda: [0, 0, 0])
    for t in texts:
        g = groups[t or ""]
        g[0], g[1], g[2] = g[0] + len((t or "").encode()) + 8, g[1] + len((t or "").split()), g[2] + 1
    total = [max(1, sum(g[d] for g in groups.values())) for d in range(3)]
    left, loads = [[1 / shards] * 3 for _ in range(shards)], [[0, 0, 0] for _ in range(shards)]
    for g in sorted(groups.values(), key=lambda g: -sum(x / n for x, n in zip(g, total))):
        part = [x / n for x, n in zip(g, total)]
        best = max(range(shards), key=lambda s: sum(a * b for a, b in zip(left[s], part)))
        left[best] = [a - b for a, b in zip(left[best], part)]
        loads[best] = [a + b for a, b in zip(loads[best], g)]
    return sorted(map(tuple, loads))


def loads(rows, shards):
    out = [[0, 0, 0] for _ in range(shards)]
    for r in rows:
        out[r.shard] = [out[r.shard][0] + r.size, out[r.shard][1] + r.n_tokens, out[r.shard][2] + 1]
    return sorted(map(tuple, out))


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "x", "y", 0) for k, t in enumerate(texts)], "doc_id long, text string, TEXT string, unit string, `group` int")


def test_as_a_plain_greedy(spark):
    docs = frame(spark, texts := [None, "", "é"] + [("w%d " % k) * (k % 41 + k % 7 * 13 + 1) for k in range(300)] + ["copy of this"] * 30)
    rows = sharding.shard_documents(docs, 5).collect()
    assert loads(rows, 5) == plain(texts, 5)
    assert len({r.shard for r in rows if r.doc_id >= 303}) == 1  # 30 copies fit a shard
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(5) for k in range(sum(r.shard == s for r in rows))]


def test_blocks_and_a_group_larger_than_a_shard(spark):
    texts = ["w%d" % k + " x" * (k % 50) for k in range(4000)] + ["copy"] * 2500 + ["a very long text " * 900]
    rows = sharding.shard_documents(frame(spark, texts), 6, blocks=12).collect()
    counts = [x[2] for x in loads(rows, 6)]
    assert len(rows) == len(texts) and max(counts) - min(counts) <= 0.1 * len(texts) / 6
    assert len({r.shard for r in rows if 4000 <= r.doc_id < 6500}) > 1
    of = defaultdict(set)
    for r in rows:
        of[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for t, s in of.items() if t != "copy")
    assert sharding.shard_documents(frame(spark, []), 3).count() == 0
