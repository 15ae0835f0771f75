"""Substring dedup against plain loops over all windows; the automaton against sets of substrings."""

import random

import pytest

pytest.importorskip("prosegrain.llm")
from prosegrain.llm.substring_dedup import Automaton, substring_dedup


def plain(rows, width):
    split = [(name, (text or "").encode().split()) for name, text in rows]
    first = {}
    for name, ws in split:
        for i in range(len(ws) - width + 1) if name is not None else ():
            w = tuple(ws[i : i + width])
            first[w] = min(first.get(w, name), name)
    out = []
    for name, ws in split:
        gone = set()
        for i in range(len(ws) - width + 1) if name is not None else ():
            if first[tuple(ws[i : i + width])] < name:
                gone.update(range(i, i + width))
        left = [w.decode() for k, w in enumerate(ws) if k not in gone]
        out.append((name, len(ws), len(gone), " ".join(left)))
    return sorted(out, key=str)


def some(seed):
    """Texts over few words with passages in common, copies, near copies, rows of one id, nulls, and one long text."""
    rng = random.Random(seed)
    words = ["a", "bb", "ç", "d.", "É", "日本", "w" * 70, "w" * 71] + [f"v{k}" for k in range(rng.choice([3, 60]))]
    passages = [[rng.choice(words) for _ in range(rng.randrange(3, 30))] for _ in range(6)]
    rows = []
    for k in range(60):
        ws = []
        for _ in range(rng.randrange(5)):
            ws += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randrange(12))]
        if ws and rng.random() < 0.3:
            ws[rng.randrange(len(ws))] = "edit"
        rows.append((rng.randrange(50) if seed % 2 else k, rng.choice([" ", "\n", "\t  "]).join(ws)))
    rows += [(k, rows[5][1]) for k in range(100, 130)] + [(None, rows[5][1]), (7, None), (8, ""), rows[9], rows[9], (-4, rows[9][1])]
    return rows + [(200, " ".join(rng.choice(words) for _ in range(30_000))), (201, " ".join(["a"] * 5000))]


def made(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, x long").toDF("doc_id", "text", "TEXT")


@pytest.mark.parametrize("seed, chunk_bytes, width, bits", [(0, 1 << 20, 13, 64), (1, 400, 13, 64), (2, 3000, 8, 64), (3, 2000, 13, 9)])
def test_kept_words_are_the_plain_ones(spark, seed, chunk_bytes, width, bits):
    rows = some(seed)
    got = substring_dedup(made(spark, rows), width=width, chunk_bytes=chunk_bytes, bits=bits)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, width)


def test_empty_table(spark):
    assert substring_dedup(made(spark, [])).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_automaton_knows_the_first_document(seed):
    rng = random.Random(seed)
    texts = [(k // 2, [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(15))]) for k in range(8)]
    automaton = Automaton(4)
    for name, ws in texts:
        automaton.add(ws, name)
    for _ in range(20):
        asked, name = [rng.choice([b"a", b"b", b"c", b"none"]) for _ in range(rng.randrange(4, 12))], rng.randrange(5)
        want = [any(ws[j : j + 4] == asked[i : i + 4] for k, ws in texts if k < name for j in range(len(ws))) for i in range(len(asked) - 3)]
        assert automaton.ends(asked, name) == want
