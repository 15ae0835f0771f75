"""The prefix trie against a plain walk over every conversation, and its defined cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("prosegrain.llm")
from prosegrain.llm.prefix_trie import Louds, prefix_trie, rebuilt_trie

SCHEMA = "conv_id long, turn long, role string, text string, TEXT string"


def plain(rows, lend=True):
    """Nodes as a dictionary from sequences to members, summed by walking up from each."""
    turns = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            turns.setdefault(c, []).append(((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest()), (r, x)))
    seqs = {c: [s for _, s in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, s in seqs.items():
        h = zlib.crc32(str(c).encode()) % 4 if lend else 0
        built[c] = tuple(seqs.get(c - c % 20, [])[:h] + s[h:])
    nodes = {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], set()).add(c)
    kids = {p: 0 for p in nodes}
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p, members in nodes.items():
        words = len([w for w in p[-1][1].translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(members) - 1) * words
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if built[c] == p)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(spark, rows):
    return spark.createDataFrame([(*r, "other") for r in rows], "c long, t long, r string, x string, other string").toDF(*[f.split()[0] for f in SCHEMA.split(", ")])


def some(seed, n):
    """Conversations of few turns, some equal, some with much in common, one long, nulls and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for c in range(0, n):
        for t in range(rng.randrange(0, 7)):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["yes", "no no", "", None, "a\tb c  d"])))
    rows += [(n, t, "user", "yes no"[: 1 + t % 5]) for t in range(60)] + [(n + 1, t, "user", "yes no"[: 1 + t % 5]) for t in range(70)]
    rows += [(n + 40 + k, t, "user", "copy of it") for k in range(30) for t in range(4)]
    return rows + [rows[0]] * 3 + [(None, 1, "user", "lost")]


@pytest.mark.parametrize("limit", [3, 40, 1 << 14])
def test_rebuilt_trie_is_the_plain_walk(spark, limit):
    rows = some(limit, 70)
    got = sorted((tuple(r) for r in rebuilt_trie(made(spark, rows), limit=limit).collect()), key=str)
    assert got == plain(rows)


def test_conversations_as_they_are(spark):
    rows = some(5, 40)
    assert sorted((tuple(r) for r in prefix_trie(made(spark, rows), limit=25).collect()), key=str) == plain(rows, lend=False)


def test_no_conversation_gives_no_node(spark):
    assert rebuilt_trie(made(spark, [])).collect() == []
    assert rebuilt_trie(made(spark, [(None, 0, "user", "a")])).collect() == []


def test_a_conversation_may_lose_all_its_turns(spark):
    lends = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)  # its base, 20, is not there
    rows = [(lends, 0, "user", "a"), (lends, 1, "user", "b")]
    assert [tuple(r) for r in rebuilt_trie(made(spark, rows)).collect()] == [(lends, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lends).encode()).hexdigest())]


def test_bits_name_the_parents():
    #      0 -> 1, 2; 1 -> 3; and 4 on its own, in another order
    level, parent = np.array([2, 0, 1, 0, 1]), np.array([2, -1, 1, -1, 1])
    t = Louds(level, parent, np.array([9, 1, 5, 2, 6]))
    assert t.order.tolist() == [1, 3, 2, 4, 0]
    assert t.parents().tolist() == [-1, -1, 0, 0, 2]
    assert np.unpackbits(t.bits, count=11).tolist() == [1, 1, 0, 1, 1, 0, 0, 1, 0, 0, 0]
    assert [v.tolist() for v in t.rolled_up(np.ones(5), np.arange(5))] == [[4, 1, 2, 1, 1], [9, 1, 6, 3, 4]]
