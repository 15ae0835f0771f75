import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("prosegrain.llm")
from prosegrain.llm import ans, packing, token_files
from prosegrain.llm.common import new_path
from prosegrain.llm.tokens import WordEncoder, default_path, encoder

TEXTS = [None, "", " ", "One two. Three, four!", "a" * 500, "word " * 9000, "x.. y., z_. a). b... c.\x85d \x1ce. f ́. g .", "\x01 a\x01b ΑΣ. É.\nÀ,\tn° 5.", "<|endoftext|> 's DON'T ÅÅ ①²½ İI ß ς Σ 1234 !!??", "One two. Three, four!"]


def ids_of(texts):
    t = encoder(default_path()).tokenizer
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("abcXYZ éÉ.,!?'_-\n\t\r\x0b\x1c\x85\xa0\x01<|>09Σςİß́ ")), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_words_give_the_ids_of_the_text(text):
    e = encoder(default_path())
    (ids,) = e.each(pa.array([text]))
    assert ids.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_symbols_behind_letters_are_encoded_once():
    e, asked = WordEncoder(default_path()), []
    plain = e._ids
    e._ids = lambda text: asked.append(text) or plain(text)
    tails = ["", ".", ",", "!!", "%%%", "'", "_)", "<|", "$|>"]
    words = [w + t for w in ("the", "unheard", "Éÿß", "straße", "àb", "ÑANDÚ") for t in tails]
    for text in (" ".join(words), " ".join(reversed(words))):  # the second from the cache
        (ids,) = e.each(pa.array([text]))
        assert ids.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
    assert sorted(asked) == sorted(tails[1:])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 3 * ans.LANES * 5), st.integers(1, 300), st.integers(0, 99))
def test_ans_round_trip(n, symbols, seed):
    rng = np.random.default_rng(seed)
    tokens = np.minimum(rng.geometric(0.1, n), symbols).astype(np.uint32)
    table = ans.Table.of_counts(np.bincount(tokens, minlength=symbols + 1))
    states, before, words = ans.encode(tokens, table)
    assert np.array_equal(ans.decode(n, states, before, words, table), tokens)


def test_ans_over_checkpoints():
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 50, 2 * ans.LANES * ans.STRIDE + 777).astype(np.uint32)
    table = ans.Table.of_counts(np.bincount(tokens))
    block = token_files.write_block(tokens, table, 5)
    got, end = token_files.read_block(memoryview(block), 0, table, 5)
    assert np.array_equal(got, tokens) and end == len(block)
    bad = bytearray(block)
    bad[len(bad) // 2] ^= 1
    with pytest.raises(ValueError):
        token_files.read_block(memoryview(bytes(bad)), 0, table, 5)


def frame(spark, texts, ids=None):
    rows = [(k if ids is None else ids[k], t, "de", "x") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string, part string")


def test_token_files(spark):
    got = {r.doc_id: r for r in token_files.token_files(frame(spark, TEXTS).repartition(3)).collect()}
    at = 0
    for k, ids in enumerate(ids_of(TEXTS)):
        ids = np.array([*ids, 2], "<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files_cases(spark):
    path = new_path(spark, "tokens")
    docs = frame(spark, ["b", "a", "c", "a"], [None, 5, None, 5])
    token_files.write_tokens(docs, path)
    rows = token_files.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 5, 5] and rows[2].ids == rows[3].ids
    assert token_files.token_files(frame(spark, [])).count() == 0


def check_packing(rows, texts, capacity):
    want = {}
    for k, ids in enumerate(ids_of(texts)):
        ids = [*ids, 1]
        for n, a in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[a : a + capacity], "<u4")
            want[k, n] = (a, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_seq)


@pytest.mark.parametrize("per_range,ranges", [(50_000, 4), (20, 2)])
def test_packing(spark, per_range, ranges):
    rng = np.random.default_rng(3)
    texts = TEXTS + [" ".join(["the"] * int(n)) for n in rng.integers(1, 60, 120)]
    capacity = 64
    rows = packing.pack(frame(spark, texts).repartition(3), capacity, per_range=per_range, ranges=ranges).collect()
    bins = check_packing(rows, texts, capacity)
    least = math.ceil(sum(len(i) + 1 for i in ids_of(texts)) / capacity)
    assert bins <= 1.05 * least + 1
    sizes = sorted((len(i) + 1 for i in ids_of(texts)), reverse=True)
    assert bins <= plain_best_fit([n for s in sizes for n in [capacity] * (s // capacity) + [s % capacity] if n], capacity) + 2


def plain_best_fit(sizes, capacity):
    """Sequences that best fit opens, largest first, one document at a time over all gaps."""
    room = []
    for s in sorted(sizes, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= s]
        if fits:
            room[min(fits, key=room.__getitem__)] -= s
        else:
            room.append(capacity - s)
    return len(room)


def test_packing_cases(spark):
    assert packing.pack(frame(spark, []), 8).count() == 0
    twice = frame(spark, ["a", "a", None], [7, 7, None])
    assert sorted((r.doc_id or 0, r.length) for r in packing.pack(twice, 8).collect()) == [(0, 1), (7, 2), (7, 2)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.lists(st.integers(1, 50), max_size=30))
def test_best_fit_takes_the_smallest_gap(items, gaps):
    items, gaps = sorted((s, k) for k, s in enumerate(items)), sorted((s, k) for k, s in enumerate(gaps))
    placed, rest, room, untouched = packing.best_fit(items, gaps)
    used = {}
    for s, k in items:
        if k in placed:
            used[placed[k]] = used.get(placed[k], 0) + s
    size = {k: s for s, k in gaps}
    assert all(size[g] - n == room[g] >= 0 for g, n in used.items())
    assert len(placed) + len(rest) == len(items) and {g for _, g in untouched} == set(size) - set(room)
    if rest and untouched:
        assert max(s for s, _ in untouched) < max(s for s, _ in rest)


def test_successors_fit():
    found = packing.successors([(0, 5, 10, 0, 0), (1, 0, 0, 2, 25), (2, 3, 30, 4, 28)])
    assert found == [(0, 0, 4, 1, 0, 2), (0, 4, 1, 2, 0, 2)]
