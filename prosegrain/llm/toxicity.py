"""Toxicity by multiple-instance learning: labels of documents, scores of sentences.

A document is a bag of all its sentences. A sentence's score is a logistic
function of its words; a document's is the noisy-or of its sentences' scores.
Only document labels are known; the noisy-or's gradient finds the sentences that
explain them, so that a scored document comes with its offending sentences.

The model is fitted on a bounded sample of labelled documents (``most`` of each
class, by hash of the id), whose whole texts go to the driver; everything else
runs over all documents and whole texts. Features are words and their first letters, chosen from the sample by
how much more often they occur under label 1.

Defined cases: a null or empty text has no sentence and gets the leak
probability; a sentence without a feature has no part in the
product, however many there are; labels that are null are left out, repeated labels of an id count
as 1 if any is 1; of several texts of a labelled id the one of least digest is
learned from; repeated documents are scored each; without a label of either
class no sentence has a feature; an empty table gives an empty result; other
columns are never read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need, tidy

STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+(?!\s)[^.!?\n]*)*[.!?]*")
WORD_CACHE = 150_000
PREFIXES = (4, 5, 6)
#: A sentence whose own probability reaches this is offending; there is no cap on their number.
OFFENDING = 0.5


class Model(NamedTuple):
    weights: dict[str, float]
    bias: float
    #: Probability of label 1 that no sentence explains.
    leak: float


def features(word: str) -> list[str]:
    w = word.lower().strip(STRIP)
    return [w, *[w[:n] + "*" for n in PREFIXES if len(w) > n]] if w else []


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans: up to a run of full stops, question or exclamation marks before white space, or a line end."""
    return [m.span() for m in SENTENCE.finditer(text) if m[0].strip()]


def choose(texts: list[str], labels: np.ndarray, most: int = 6000, least: int = 4) -> list[str]:
    """Features whose share of label-1 documents is at least thrice that of the others, by log-likelihood ratio."""
    seen = (Counter(), Counter())
    for t, y in zip(texts, labels):
        seen[y].update({f for w in set(t.split()) for f in features(w)})
    n0, n1 = max(1, int((labels == 0).sum())), max(1, int(labels.sum()))
    ranked = []
    for f, a in seen[1].items():
        b = seen[0][f]
        if a < least or a / n1 < 3 * b / n0:
            continue
        p = (a + b) / (n0 + n1)
        g = 2 * (a * np.log(a / (n1 * p)) + (b * np.log(b / (n0 * p)) if b else 0))
        if g >= 15.13:
            ranked.append((-g, f))
    return [f for _, f in sorted(ranked)[:most]]


def fit(texts: list[str], labels: list[int], steps: int = 300, rate: float = 0.3, decay: float = 2e-4) -> Model:
    """Full-batch Adam on the noisy-or likelihood; classes weigh the same."""
    y = np.array(labels, dtype=np.int64)
    leak = 0.02
    if not len(y) or y.min() == y.max():
        return Model({}, -math.inf, leak)
    names = choose(texts, y)
    number = {f: k for k, f in enumerate(names)}
    known: dict[str, list[int]] = {}
    feature, bag, doc_of = [], [], []
    for d, t in enumerate(texts):
        for a, b in sentences(t):
            found = []
            for w in t[a:b].split():
                if (got := known.get(w)) is None:
                    got = known[w] = [number[f] for f in features(w) if f in number]
                found += got
            if found:
                feature += found
                bag += [len(doc_of)] * len(found)
                doc_of.append(d)
    feature, bag, doc_of = (np.array(x, dtype=np.int64) for x in (feature, bag, doc_of))
    n_bags, n = len(doc_of), len(y)
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    w, bias = np.zeros(len(names)), -2.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, steps + 1):
        z = np.bincount(bag, w[feature], n_bags) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-9)), n) + np.log1p(-leak)
        is_toxic = -np.expm1(none)
        push = np.where(y == 1, -np.exp(none) / np.maximum(is_toxic, 1e-9), 1.0) * weight
        dz = push[doc_of] * p / n
        grad = np.concatenate([np.bincount(feature, dz[bag], len(names)) + decay * w, [dz.sum()]])
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model({f: float(x) for f, x in zip(names, w) if abs(x) > 1e-3}, float(bias), leak)


def logistic(z: float) -> float:
    return 1 / (1 + math.exp(-min(30.0, max(-700.0, z))))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.cache = model, {}

    def learn(self, new: set[str]) -> None:
        weights = self.model.weights
        for w in new:
            self.cache[w] = tuple(weights[f] for f in features(w) if f in weights) or None

    def __call__(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """(document's score, all its offending sentences as (start, stop, score) in code points, in order of place)."""
        words = set(text.split())
        new = words.difference(self.cache)
        if new:
            if len(self.cache) + len(new) > WORD_CACHE:
                self.cache, new = {}, words
            self.learn(new)
        none, found = 1 - self.model.leak, []
        for a, b in sentences(text) if any(map(self.cache.get, words)) else ():
            told = [x for w in text[a:b].split() for x in (self._of(w) or ())]
            if told:
                p = logistic(sum(told) + self.model.bias)
                none *= 1 - p
                if p >= OFFENDING:
                    found.append((a, b, p))
        return 1 - none, found

    def _of(self, w: str) -> tuple[float, ...] | None:
        if w not in self.cache:  # a sentence may end inside what stands between blanks
            self.learn({w})
        return self.cache[w]


def training_sample(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = 4000) -> tuple[list[str], list[int]]:
    """Texts and labels, at most ``most`` of each class, those whose hash of the id is smallest."""
    marked = need(labels, id_col, label_col).where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if usable is not None:
        marked = marked.where(usable)
    by_id = marked.groupBy(F.col(id_col).alias("of")).agg(F.max(label_col).cast("int").alias("y"))
    order = (F.xxhash64("of"), F.col("of"))
    chosen = by_id.where("y = 0").orderBy(*order).limit(most).union(by_id.where("y = 1").orderBy(*order).limit(most))
    # At most 2 * most ids: bounded by a parameter, so it is broadcast.
    texts = need(docs, id_col, text_col).join(F.broadcast(chosen), F.col(id_col) == F.col("of"))
    texts = texts.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"), "y", F.col("of"))
    rows = texts.groupBy("of").agg(F.min(F.struct(F.md5("t").alias("digest"), F.col("t"))).alias("x"), F.first("y").alias("y")).select("x.t", "y", "of").collect()
    rows.sort(key=lambda r: r["of"])
    return [r["t"] for r in rows], [r["y"] for r in rows]


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("score", "offending")) -> DataFrame:
    """``docs`` with two more columns: the score, and (start, stop, score) of every sentence that scores ``OFFENDING`` or more."""
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number of features
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("score", T.DoubleType())])
    by_place = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names may clash
    schema = T.StructType([*by_place.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    at = docs.columns.index(text_col)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for batch in batches:
            found = [score(t.as_py() or "") for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x for x, _ in found], pa.float64()), pa.array([[{"start": a, "stop": b, "score": p} for a, b, p in s] for _, s in found], kind)],
                [*batch.schema.names, "score", "spans"],
            )

    return by_place.mapInArrow(tidy(run), schema).toDF(*docs.columns, *names)


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fold that is never learned from."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row a document: id, held_out, score, offending."""
    model = fit(*training_sample(docs, labels, ~held_out(id_col), id_col, text_col, **options))
    rows = need(docs, id_col, text_col).select(F.col(id_col), F.col(text_col).alias("text"))
    return score_documents(rows, model).select(id_col, held_out(id_col).alias("held_out"), "score", "offending")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more."""
    model = fit(*training_sample(docs, labels, ~held_out(id_col), id_col, text_col, **options))
    scored = score_documents(docs, model, text_col)
    by_place = scored.toDF(*[f"c{k}" for k in range(len(scored.columns))])
    n = len(docs.columns)
    return by_place.where(F.col(f"c{n}") < threshold).select(*[f"c{k}" for k in range(n)]).toDF(*docs.columns)
