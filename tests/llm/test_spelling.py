"""Spelling variants against plain loops over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("prosegrain.llm")
from prosegrain.llm.spelling import near_pairs, near_words, spelling_variants


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def some_words(seed, n, sizes, letters="abÿé"):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.choice(sizes))) for _ in range(n)})


@pytest.mark.parametrize("seed", range(6))
def test_near_words_finds_each_pair_once(seed):
    words = some_words(seed, 80, (0, 1, 2, 3, 4, 5))
    group = np.array([k % 2 for k in range(len(words))])
    x, y = near_words(group, [w.encode("latin-1") for w in words])
    got = sorted(tuple(sorted(p)) for p in zip(x.tolist(), y.tolist()))
    assert got == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if (i - j) % 2 == 0 and one_edit(words[i], words[j])]
    assert all(len(words[i]) <= len(words[j]) for i, j in zip(x, y))


@pytest.mark.parametrize("limit", [2, 9, 20_000])
def test_near_pairs_in_partitions_of_any_size(spark, limit):
    words = some_words(limit, 300, (6, 7, 8), "ab") + ["a" * 40, "a" * 41, "a" * 40 + "b"]
    got = sorted((r.word, r.other) for r in near_pairs(spark.createDataFrame([(w, 7) for w in words], "word string, n long"), limit=limit).collect())
    assert got == sorted((a, b) for a in words for b in words if one_edit(a, b))


def plain(rows, noise):
    n = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    form, out = {}, []
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 5 * n[w]:
            form[w] = best
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(out, key=str)


@pytest.mark.parametrize("noise", [None, 3])
def test_variants_over_texts(spark, noise):
    rng = random.Random(1)
    names = ["gardens", "garden", "gardans", "gardanz", "wörter×es", "Wörter×es", "straßenÀ", "Straßen", "evening", "evenings", "short", "日本gardens日"]
    weights = [400, 70, 60, 9, 30, 30, 60, 10, 200, 6, 50, 5]
    rows = [(k, " ".join(rng.choices(names, weights, k=rng.randrange(60)))) for k in range(60)]
    rows += [(None, "gardens evening"), (7, None), (8, ""), rows[0], (9, "x" * 300_000 + " " + "evenings, " * 120_000)]
    docs = spark.createDataFrame([(*r, "") for r in rows], "doc_id long, text string, o string").toDF("doc_id", "text", "TEXT")
    want = plain(rows, noise)
    assert sorted((tuple(r) for r in spelling_variants(docs, noise=noise).collect()), key=str) == want
    assert any(r[1] != r[2] for r in want if r[1])  # a chain


def test_empty_table(spark):
    assert spelling_variants(spark.createDataFrame([], "doc_id long, text string"), noise=199).collect() == []
