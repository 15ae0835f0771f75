import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("prosegrain.llm")
import corpus_pipeline
from prosegrain.llm import jaccard_join, parsing, toxicity
from prosegrain.llm.queries import QUERIES

DIR = "/root/testdata/sf0.01"


# --- toxicity ---------------------------------------------------------------


def made(n, seed=0):
    rng = random.Random(seed)
    calm, rude = [f"calm{k}" for k in range(300)], ["grobian", "grobians", "lout"]
    docs = []
    for k in range(n):
        sents = [" ".join(rng.choices(calm, k=8)) + "." for _ in range(rng.randrange(1, 8))]
        y = int(rng.random() < 0.3)
        if y:
            at = rng.randrange(len(sents))
            sents[at] = sents[at].replace(" ", f" {rng.choice(rude)} ", 1)
        docs.append((k, " ".join(sents), y))
    return docs


def frames(spark, rows):
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t, _ in rows], "doc_id long, text string, score int, offending string")
    labels = spark.createDataFrame([(k, 0, y) for k, _, y in rows], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy_and_sentences(spark):
    rows = made(900)
    truth = {k: (t, y) for k, t, y in rows}
    got = toxicity.toxicity(*frames(spark, rows)).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {k for k in truth if zlib.crc32(str(k).encode()) % 3 == 1}
    assert np.mean([(r.score >= 0.7) == truth[r.doc_id][1] for r in held]) > 0.97
    for r in held:
        if truth[r.doc_id][1]:
            best = max(r.offending, key=lambda s: s.score)
            assert any(w in truth[r.doc_id][0][best.start : best.stop] for w in ("grobian", "lout"))


def test_labels_of_the_held_out_fold_change_nothing(spark):
    rows = made(300)
    docs, labels = frames(spark, rows)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = lambda x: sorted((r.doc_id, r.score) for r in toxicity.toxicity(docs, x).collect())
    assert scores(labels) == scores(flipped)


def test_toxicity_cases(spark):
    rows = made(200) + [(9001, None, None), (9002, "", 0), (9003, "grobian " * 20_000, None), (9003, "grobian " * 20_000, 1), (None, "grobian.", 1)]
    docs, labels = frames(spark, rows)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert got[9001].score == got[9002].score < 0.1 and got[9003].score > 0.9 and got[None].held_out is False
    one_class = toxicity.toxicity(docs, labels.where("toxic = 0")).collect()
    assert all(got[9001].score <= r.score < 0.03 and not r.offending for r in one_class)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0 and toxicity.toxicity(docs, labels.limit(0)).count() == len(rows)
    kept = toxicity.drop_toxic(docs.drop("score", "offending"), labels)
    assert kept.columns == ["doc_id", "text"] and 9001 in {r.doc_id for r in kept.collect()} and 9003 not in {r.doc_id for r in kept.collect()}


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .!?\n", max_size=60))
def test_sentences_cover_the_text(text):
    spans = toxicity.sentences(text)
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    assert "".join(text[a:b] for a, b in spans).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")


# --- fingerprints -----------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(200, 900), st.integers(0, 60), st.integers(0, 60))
def test_equal_stretches_share_interior_names(seed, n, before, after):
    rng = np.random.default_rng(seed)
    middle = bytes(rng.integers(97, 105, n, dtype=np.uint8))
    other = bytes(rng.integers(97, 105, before, dtype=np.uint8)) + middle + bytes(rng.integers(97, 105, after, dtype=np.uint8))
    for (names, *_), (more, *_) in zip(parsing.parse([middle]), parsing.parse([other])):
        inner = names[12:-12].tolist()
        if inner:
            assert "".join(f"|{x}" for x in inner) in "".join(f"|{x}" for x in more.tolist())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aab é🎉\n", max_size=80), max_size=6))
def test_a_lot_gives_what_single_texts_give(texts):
    data = [t.encode() for t in texts]
    assert parsing.fingerprints(data) == [parsing.fingerprints([d])[0] for d in data] if data else True


def test_fingerprint_documents(spark):
    rng = random.Random(1)
    texts = [None, "", "é", "aaaa" * 200, "ab" * 5000] + [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(1, 300))) for _ in range(60)]
    rows = [(3 * k, t, 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int")
    got = {r.doc_id: r for r in parsing.fingerprint_documents(df.repartition(7)).collect()}
    whole = [t or "" for t in texts]
    for k, t in enumerate(whole):
        r, following = got[3 * k], whole[(k + 1) % len(whole)]
        n = len(t) // 4
        changed = t[: len(t) - n] + following[:n]
        a, e, b = parsing.fingerprints([t.encode(), changed.encode(), following.encode()])
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(changed.encode()).hexdigest(), a.hex(), e.hex())
        assert r.near_edited == parsing.likeness(a, e) and r.near_next == parsing.likeness(a, b)
    long = [r for r in got.values() if r.n_chars > 400 and r.doc_id > 12]
    assert min(r.near_edited for r in long) > 0.3 > 0.15 > max(r.near_next for r in long)


def test_fingerprint_cases(spark):
    schema = "doc_id long, text string"
    assert parsing.fingerprint_documents(spark.createDataFrame([], schema)).count() == 0
    (one,) = parsing.fingerprint_documents(spark.createDataFrame([(5, "abcdefgh")], schema)).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1.0
    rows = [(None, "x"), (None, None), (4, "y"), (4, "y")]
    got = parsing.fingerprint_documents(spark.createDataFrame(rows, schema)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((r.doc_id or 0, r.n_chars, r.fingerprint == "00", r.edited_sha256) for r in got) == sorted([(0, 0, True, sha("")), (0, 1, False, sha("x")), (4, 1, False, sha("y")), (4, 1, False, sha("y"))])
    clash = spark.createDataFrame([(k, f"text {k} " * 30, "z", 0) for k in range(40)], "doc_id long, text string, TEXT string, `range` int")
    got = {r.doc_id: r for r in parsing.fingerprint_documents(clash, range_bytes=512, task_bytes=2048).collect()}
    for k in range(40):
        text, following = f"text {k} " * 30, f"text {(k + 1) % 40} " * 30
        assert got[k].edited_sha256 == sha(text[: len(text) - len(text) // 4] + following[: len(text) // 4])


# --- pipeline ---------------------------------------------------------------


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    now, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, DIR).persist()
        assert now.schema.names == docs.schema.names
        seen.append({"rows": now.collect()})
    clean, unique, safe, mixed = ({r.doc_id: r.text for r in s["rows"]} for s in seen)
    total = docs.count()
    assert sum(labels.get(k) == 0 for k in clean) == sum(y == 0 for y in labels.values())
    assert 0.85 * total < len(clean) < total
    # one of each class of what the first stage kept, by brute force
    sets = {}
    for k in sorted(clean):
        w = (clean[k] or "").encode().lower().split()
        s = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset([k])
        sets[k] = s
    up = {k: k for k in sets}
    by = {}
    for k, s in sets.items():
        near = {}
        for x in s:
            for j in by.setdefault(x, []):
                near[j] = near.get(j, 0) + 1
            by[x].append(k)
        for j, both in near.items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = k, j
                while up[a] != a:
                    a = up[a]
                while up[b] != b:
                    b = up[b]
                up[max(a, b)] = min(a, b)
    assert set(unique) == {k for k in up if up[k] == k}
    assert set(safe) == set(unique) and not any("token = \"" in (t or "") and len(t.split("token = \"")[1].split("\"")[0]) == 40 for t in safe.values())
    assert set(mixed) <= set(safe) and all(safe[k] == t for k, t in mixed.items())
    packed = corpus_pipeline.STAGES[-1][1](spark, now, DIR).collect()
    assert len({(r.doc_id) for r in packed}) == len(mixed)
    assert sum(r.piece == 0 for r in packed) == len(seen[3]["rows"])


def test_queries_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5 and jaccard_join.Bands(80).percent == 80
