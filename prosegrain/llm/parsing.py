"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases, the phrases' names again, level by
level until one phrase is left. Runs of one name become one name first.
Deterministic coin tossing then gives each place a label under six that depends
on a few names to the left only and differs from its neighbour's; a phrase
begins at each local maximum. So an equal stretch of two texts is parsed alike,
but for a few phrases at its ends, wherever it stands. A phrase's name is a hash
of its content.

The fingerprint is a weighted sample of the names of all levels: a name's key is
its hash divided by the number of bytes its phrase spans, and the ``KEEP``
smallest keys stay, or one in ``SHARE`` if that is more, so that an equal
stretch leaves its share of names in both fingerprints at any length. Every
level covers the text once, so every level has a like part of the sample.
Likeness estimates the share of phrases of all levels that two texts have in
common, each weighed by the bytes it spans; phrases so long that every sample
has them weigh alike. All texts are treated alike, whatever their size.

Defined cases: a null text is an empty one and its fingerprint is ``00``; two
empty texts are alike (1.0), an empty and another one are not (0.0); equal ids
are ordered by text; null ids come first; repeated rows are documents of their
own; a table of one document has it for its own successor; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, need, tidy

U = np.uint64
LOT_CHARS = 1 << 20
#: Bytes of texts in a range of ids, and in a task, which has several ranges.
RANGE_BYTES, TASK_BYTES = 1 << 21, 1 << 24
#: Names kept of a text, all levels together; one in SHARE if that is more.
KEEP, SHARE = 96, 8
#: Bytes of a key that are kept, and texts whose numbers fit beside it in a word.
KEY_BYTES = 6
MOST_TEXTS = 1 << (64 - 8 * KEY_BYTES)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def toss(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Twice the lowest bit place in which the names differ, plus the right name's bit there."""
    d = left ^ right
    low = np.minimum(np.bitwise_count((d & (~d + d.dtype.type(1))) - d.dtype.type(1)), d.dtype.itemsize * 8 - 1).astype(d.dtype)
    return (2 * low + ((right >> low) & d.dtype.type(1))).astype(np.uint8)


#: toss() of all pairs of bytes, so the first level looks its labels up.
_ALL = np.arange(256, dtype=np.uint8)
TOSS = toss(np.repeat(_ALL, 256), np.tile(_ALL, 256))
BYTES = mix(np.arange(256 * 16, dtype=np.uint64) + U(1))
PLACES = mix(np.arange(16, dtype=np.uint64) + U(0xABCDEF)) | U(1)


def _labels(first: np.ndarray, heads: np.ndarray, rounds: int) -> np.ndarray:
    """Toss labels again ``rounds`` times; a text's first place is tossed against zero."""
    x = first
    for _ in range(rounds):
        left = np.empty_like(x)
        left[1:] = x[:-1]
        left[heads] = 0
        x = TOSS[(left.astype(np.uint16) << 8) | x]
    return x


def _starts(label: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Places where a phrase begins: heads of texts and local maxima of the labels."""
    n = len(label)
    up, down = np.ones(n, bool), np.ones(n, bool)
    up[1:] = label[1:] > label[:-1]
    down[:-1] = label[:-1] >= label[1:]
    begin = up & down
    begin[heads] = True
    if n > 1:  # a text's second place begins none: its label may hang on the text's head
        second = heads[heads + 1 < n] + 1
        keep = np.zeros(n, bool)
        keep[heads] = True
        begin[second] &= keep[second]
    return np.flatnonzero(begin)


def _folded(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one name as one: (names, run lengths, texts' sizes)."""
    heads = (np.cumsum(sizes) - sizes)[sizes > 0]
    own = np.ones(len(x), bool)
    own[1:] = x[1:] != x[:-1]
    own[heads] = True
    at = np.flatnonzero(own)
    runs = np.diff(np.append(at, len(x)))
    before = np.concatenate([[0], np.cumsum(own)])
    ends = np.cumsum(sizes)
    return x[at], runs, before[ends] - before[ends - sizes]


def _phrases(x: np.ndarray, runs: np.ndarray, sizes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names of the phrases, where each begins, phrases of each text)."""
    heads = (np.cumsum(sizes) - sizes)[sizes > 0]
    if x.dtype == np.uint8:
        first, rounds = x, 3
    else:
        left = np.empty_like(x)
        left[1:] = x[:-1]
        left[heads] = 0
        first, rounds = toss(left, x), 3
    begin = _starts(_labels(first, heads, rounds), heads)
    lengths = np.diff(np.append(begin, len(x)))
    place = (np.arange(len(x), dtype=np.int32) - np.repeat(begin.astype(np.int32), lengths)) & 15
    with np.errstate(over="ignore"):
        value = BYTES[(place << 8) | x] if x.dtype == np.uint8 else mix(x) * PLACES[place]
        long_ = runs > 1
        value[long_] = mix(value[long_] + runs[long_].astype(U))
        names = mix(np.add.reduceat(value, begin) + lengths.astype(U) + U(level << 40))
    ends = np.cumsum(sizes)
    before = np.searchsorted(begin, np.stack([ends - sizes, ends]))
    return names, begin, before[1] - before[0]


def parse(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level up to the top: (names of all texts' phrases in order, bytes each spans, phrases of each text).

    A text that is down to one phrase has no part in higher levels.
    """
    x, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], dtype=np.int64)
    spans = np.ones(len(x), np.int64)
    out = []
    while len(x):
        names, runs, folded = _folded(x, sizes)
        spans = np.add.reduceat(spans, np.cumsum(runs) - runs)
        level = len(out) + 1
        x, begin, sizes = _phrases(names, runs, folded, level)
        spans = np.add.reduceat(spans, begin)
        out.append((x, spans, sizes))
        more = sizes > 1
        if not more.all():
            go_on = np.repeat(more, sizes)
            x, spans, sizes = x[go_on], spans[go_on], np.where(more, sizes, 0)
    return out


def fingerprints(texts: list[bytes]) -> list[bytes]:
    """A byte that tells the form, then the kept keys, KEY_BYTES each, ascending; the byte is 0 for all of a text's names, 1 for a sample."""
    if len(texts) > MOST_TEXTS:
        return [mark for k in range(0, len(texts), MOST_TEXTS) for mark in fingerprints(texts[k : k + MOST_TEXTS])]
    number = np.arange(len(texts), dtype=np.uint64)
    place = U(8 * KEY_BYTES)
    keys = [(np.repeat(number, sizes) << place) | ((mix(names) // spans.astype(U)) >> (U(64) - place)) for names, spans, sizes in parse(texts)]
    key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, U)
    own = np.ones(len(key), bool)
    own[1:] = key[1:] != key[:-1]
    key = key[own]
    bounds = np.searchsorted(key >> place, np.arange(len(texts) + 1, dtype=np.uint64))
    starts, ends = bounds[:-1], bounds[1:]
    kept = np.minimum(ends, starts + np.maximum(KEEP, -((starts - ends) // SHARE)))
    data = key.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - KEY_BYTES :].tobytes()
    return [bytes([c < b]) + data[KEY_BYTES * a : KEY_BYTES * c] for a, b, c in zip(starts.tolist(), ends.tolist(), kept.tolist())]


def _keys(mark: bytes) -> list[bytes]:
    return [mark[k : k + KEY_BYTES] for k in range(1, len(mark), KEY_BYTES)]


def likeness(a: bytes, b: bytes) -> float:
    """Estimated share of common phrases of all levels, weighed by their bytes, 0 to 1."""
    if a == b:
        return 1.0
    x, y = _keys(a), _keys(b)
    both, union = {*x} & {*y}, sorted({*x, *y})
    # Beyond the last key of a sample nothing is known of that text.
    known = min([keys[-1] for mark, keys in ((a, x), (b, y)) if mark[0]], default=None)
    seen = union if known is None else [k for k in union if k <= known]
    return sum(k in both for k in seen) / len(seen) if seen else 0.0


def edited(text: str, following: str) -> str:
    """The last quarter of the code points, rounded down, replaced by the first as many of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compare(texts: list[str], following: list[str], own: list[bytes] | None = None, next_: list[bytes] | None = None) -> list[tuple]:
    """(n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each text."""
    changed = [edited(a, b).encode() for a, b in zip(texts, following)]
    own = own if own is not None else fingerprints([t.encode() for t in texts])
    next_ = next_ if next_ is not None else fingerprints([t.encode() for t in following])
    return [(len(t), hashlib.sha256(c).digest(), a, e, likeness(a, e), likeness(a, b)) for t, c, a, e, b in zip(texts, changed, own, fingerprints(changed), next_)]


#: Hashes and fingerprints travel as bytes and become hex at the end.
RESULT = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_KINDS = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
_NAMES = [c.split()[0] for c in RESULT.split(", ")]


def _bounds(rows: DataFrame, parts: int) -> DataFrame:
    """One row: the (id, tie) at which each of at most ``parts`` ranges begins, in lists of about the root of their number.

    Ranges of equal numbers of rows, from the ids alone; equal (id, tie) are
    never parted. Written, as the ranges come from a sample.
    """
    keys = rows.select(F.struct("id", "tie").alias("key"))
    firsts = keys.repartitionByRange(parts, "key").groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("key"))
    every = max(1, math.isqrt(parts))
    lists = firsts.agg(F.sort_array(F.collect_list("key")).alias("all"))  # bounded by the number of ranges
    starts = F.sequence(F.lit(1), F.greatest(F.size("all"), F.lit(1)), F.lit(every))
    return cut(lists.select(F.transform(starts, lambda k: F.slice("all", k, every)).alias("bounds"), F.lit(every).alias("every"), F.size("all").alias("ranges")), "bounds")


def _place(key: Column, bounds: Column) -> Column:
    """(the number of the list of ``bounds`` that ``key`` falls in, its place in the list): the last bound that is not above it."""
    last = lambda found: F.greatest(F.size(found) - 1, F.lit(0))
    row = last(F.filter(bounds, lambda b: F.get(b, F.lit(0)) <= key))
    return let(row, lambda r: F.struct(r.alias("row"), last(F.filter(F.get(bounds, r), lambda b: b <= key)).alias("at")))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """One row a document, compared with its edited text and with the next document by id.

    Documents are dealt to ranges of ids, each of about ``range_bytes``, and a
    task walks through each of its ranges in order. The first document of a
    range goes to the range before as well, where it follows the last one; so
    texts are shuffled once and nothing is written in between.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = need(docs, id_col, text_col).select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    least = rows.sparkSession.sparkContext.defaultParallelism
    bounds = _bounds(rows, max(-(-size // range_bytes), least))
    ranged = rows.crossJoin(F.broadcast(bounds)).withColumn("place", _place(F.struct("id", "tie"), F.col("bounds")))  # one row, a key a range
    number = F.col("place.row") * F.col("every") + F.col("place.at")
    own = ranged.select(number.alias("range"), F.lit(False).alias("follows"), "id", "tie", "text")
    # A range's first document is the one at its bound; equal rows are one. The first of all follows the last.
    at_bound = F.get(F.get(F.col("bounds"), F.col("place.row")), F.col("place.at"))
    heads = ranged.where(F.struct("id", "tie").eqNullSafe(at_bound)).select(F.pmod(number - 1, F.col("ranges")).alias("range"), "id", "tie", "text")
    follow = heads.groupBy("range").agg(F.lit(True).alias("follows"), F.first("id").alias("id"), F.first("tie").alias("tie"), F.min("text").alias("text"))
    dealt = own.union(follow).repartition(max(-(-size // task_bytes), least), "range")
    dealt = dealt.sortWithinPartitions("range", "follows", "id", "tie", "text").select("range", "follows", "id", "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held, at_range = None, [], 0, None

        def lot() -> pa.RecordBatch:
            """All held documents but the last, which is only followed by what comes."""
            marks = fingerprints([t.encode() for t in texts])
            found = compare(texts[:-1], texts[1:], marks[:-1], marks[1:])
            return pa.RecordBatch.from_arrays([ids.slice(0, len(found)), *[pa.array([f[k] for f in found], t) for k, t in enumerate(_KINDS)]], ["id", *_NAMES])

        for batch in batches:
            at = 0
            for k, (r, last, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3))):
                if r != at_range:  # the range before ended with the document that follows it
                    ids, texts, held, at, at_range = None, [], 0, k, r
                texts.append(t.as_py())
                held += len(texts[-1])
                if held >= LOT_CHARS or last or k == len(batch) - 1:
                    new = batch.column(2).slice(at, k + 1 - at)
                    ids, at = (new if ids is None else pa.concat_arrays([ids, new])), k + 1
                    if len(texts) > 1:
                        yield lot()
                    ids, texts, held = ids.slice(len(ids) - 1), texts[-1:], len(texts[-1])

    out = dealt.mapInArrow(tidy(walk), f"id {kind}, {RESULT}")
    return out.select(F.col("id").alias(id_col), *[F.lower(F.hex(c)).alias(c) if k == pa.binary() else F.col(c) for c, k in zip(_NAMES, _KINDS)])
