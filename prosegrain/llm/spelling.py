"""Spelling variants: words one edit apart, by a self-join of tries with active-node sets.

Words. Texts are read as Latin-1 bytes, so a code point is a byte and a run of
letters a stretch between blanks; each task counts its own runs, and one
shuffle adds them up.

Partitions. Of two words one edit apart, the shorter of length a, either the
first a // 2 letters agree or the last a - a // 2 do. So each word goes to the
tries of its first half and, read backwards, of its last half, once with its
length as a and once as the longer of two. A partition of more than ``limit``
words is dealt out by the next letter for the edits that come later; edits at
that very letter meet under what follows it, where at most one word for each
letter of the alphabet and one without can stand.

Join. A batch of partitions is one forest, built level by level in numpy.
Beside each node stand its active nodes, those one edit away: siblings
(a letter replaced) and children (a letter more). They go down together: a pair
lives on only in children of one label. A pair whose two nodes both end a word
is put out. A pair is only opened at the first letter where the words differ, so
it is found once. Nodes under which one word is left and that are in no pair
are not gone down.

Forms. A word's form is its near word of largest count; roots come by pointer
jumping over the forms, in as many rounds as the logarithm of the longest chain.

Defined cases: a null or empty text has no word; a null id is written as no
digits before the colon; repeated rows count again; an empty table gives an
empty result; other columns are ignored, whatever their names. A run of any
length is a word.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, need, tidy
from .jaccard_join import in_runs

#: Latin-1 bytes of letters as they are, A to Z folded, the others as blanks.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: Bytes of a text handled at once, and words a task holds before it puts their counts out.
LOT_BYTES, HELD_WORDS = 1 << 20, 200_000
#: Words in a partition that one task takes whole.
LIMIT = 20_000


def lots(text: str) -> Iterator[list[bytes]]:
    """Lower-cased runs of letters as Latin-1 bytes, from about a megabyte of text at a time, cut between runs."""
    data = text.encode("latin-1", "replace").translate(LETTERS)
    at = 0
    while at < len(data):
        stop = len(data) if len(data) - at <= LOT_BYTES else data.find(b" ", at + LOT_BYTES)
        stop = len(data) if stop < 0 else stop
        yield data[at:stop].split()
        at = stop


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, noise: int | None = 199) -> DataFrame:
    """(word, n): runs of ``least`` letters or more over all texts.

    With ``noise``, a run of a document whose crc32 of ``<id>:<run>`` it divides loses the letter at crc32 % length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def put() -> pa.RecordBatch:
            kept = [(w.decode("latin-1"), n) for w, n in held.items() if len(w) >= least]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                start = zlib.crc32(f"{name.as_py() or ''}:".encode())
                for words in lots(text.as_py() or ""):
                    if noise is None:
                        held.update(words)
                    else:
                        for w, n in Counter(words).items():
                            crc = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                            if crc % noise == 0:
                                w = w[: crc % len(w)] + w[crc % len(w) + 1 :]
                            held[w] += n
                    if len(held) >= HELD_WORDS:
                        yield put()
                        held = Counter()
        yield put()

    texts = need(docs, id_col, text_col).select(F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("text"))
    return texts.mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _children(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of ``nodes``, number of a child of it), a row a child; ``keys`` are sorted parent * 256 + label."""
    low, high = np.searchsorted(keys, nodes << 8), np.searchsorted(keys, (nodes + 1) << 8)
    size = high - low
    of = np.repeat(np.arange(len(nodes)), size)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + low[of]


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of ``wanted`` are keys, their numbers)."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = np.flatnonzero(keys[at] == wanted)
    return hit, at[hit]


def _siblings(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes of one parent; ``parent`` is sorted, and a node has at most 256 children."""
    left, right, step = [], [], 1
    while True:
        i = np.flatnonzero(parent[step:] == parent[:-step]) if step < len(parent) else np.zeros(0, np.int64)
        if not len(i):
            return (np.concatenate(left), np.concatenate(right)) if left else (i, i)
        left.append(i), right.append(i + step)
        step += 1


def near_words(group: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of numbers of words of one group that are one edit apart; of unequal lengths the shorter is first.

    ``group`` numbers the groups from 0; the words of a group are distinct.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size) - size
    letters = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    none = np.zeros(0, np.int64)
    node, alive, n_nodes = group.astype(np.int64).copy(), np.arange(len(words)), int(group.max(initial=-1)) + 1

    def ending(words: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, -1, np.int64)
        out[node[words]] = words
        return out

    ends = ending(alive[size == 0], n_nodes)
    level_keys = none  # of this level's nodes
    same = (none, none)  # active pairs of one level
    more = (none, none, none)  # (node of the level above, node of this level, label that must not follow or -1)
    left, right, depth = [], [], 0
    while len(alive):
        of, child = _children(level_keys, more[0])
        fits = (level_keys[child] & 255) != more[2][of]
        of, child = of[fits], child[fits]
        wanted = np.bincount(node[alive], minlength=n_nodes) > 1
        for x in (*same, more[1], child):
            wanted[x] = True
        alive = alive[wanted[node[alive]] & (size[alive] > depth)]
        keys, number = np.unique((node[alive] << 8) | letters[start[alive] + depth], return_inverse=True)
        node[alive] = number
        after = ending(alive[size[alive] == depth + 1], len(keys))
        parent, label = keys >> 8, keys & 255
        # Pairs of one level go down to children of one label; siblings are new pairs.
        by, a = _children(keys, same[0])
        hit, b = _found(keys, (same[1][by] << 8) | label[a])
        a, (c, d) = a[hit], _siblings(parent)
        same = np.concatenate([a, c]), np.concatenate([b, d])
        # So do pairs whose second node is a level deeper; a child beside its parent is a new one, where the parent has another way on.
        hit, b = _found(keys, (more[1][of] << 8) | (level_keys[child] & 255))
        ways = np.bincount(parent, minlength=n_nodes) + (ends >= 0)
        fresh = np.flatnonzero(ways[parent] > 1)
        more = np.concatenate([child[hit], parent[fresh]]), np.concatenate([b, fresh]), np.concatenate([np.full(len(hit), -1), label[fresh]])
        for x, y in ((after[same[0]], after[same[1]]), (ends[more[0]], after[more[1]])):
            both = (x >= 0) & (y >= 0)
            left.append(x[both]), right.append(y[both])
        level_keys, ends, n_nodes, depth = keys, after, len(keys), depth + 1
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def partitions(words: DataFrame, least: int, limit: int) -> DataFrame:
    """words (word, n) -> (lot, key, word, n, shorter, back, at, here): the partitions that a word is in.

    ``back``: words are read from their end. ``at``: letters that the partition has in common. ``here``: its edits are at
    that place alone, and what follows is in common too.
    """
    size = F.length("word")
    once = words.select("word", "n", F.explode(F.when(size > least, F.array(size, size - 1)).otherwise(F.array(size))).alias("shorter"))
    both = once.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
    half = F.floor(F.col("shorter") / 2).cast("int")
    read = F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))
    rows = both.select("word", "n", "shorter", "back", F.when(F.col("back"), F.col("shorter") - half).otherwise(half).alias("at"), F.lit(False).alias("here"))

    def key(what, *more):
        return F.concat_ws(" ", F.col("shorter").cast("string"), F.col("back").cast("string"), what, *more)

    def begun(rows: DataFrame) -> DataFrame:
        return rows.withColumn("key", key(F.substring(read, F.lit(1), F.col("at"))))

    rows, done = begun(rows), []
    while True:
        large = cut(rows.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > limit).select("key"), "large")
        done.append(rows.join(large, "key", "left_anti"))
        if not large.limit(1).count():
            break
        rest = cut(rows.join(large, "key", "left_semi"), "rest")
        head, tail = F.substring(read, F.lit(1), F.col("at")), F.substring(read, F.col("at") + 1, size)
        after = F.substring(read, F.col("at") + 2, size)
        # As one that has a letter here, and, of the shorter length, as one that lacks it.
        ways = F.when(size == F.col("shorter"), F.array(tail, after)).otherwise(F.array(after))
        met = rest.withColumn("here", F.lit(True)).withColumn("follows", F.explode(ways))
        done.append(met.withColumn("key", key(head, F.lit("."), F.col("follows"))).drop("follows"))
        rows = begun(rest.where(size > F.col("at")).withColumn("at", F.col("at") + 1))
    out = done[0].select("key", "word", "n", "shorter", "back", "at", "here")
    for more in done[1:]:
        out = out.union(more.select(*out.columns))
    return out.select(F.xxhash64("key").alias("lot"), *out.columns)


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partitions sorted by (lot, key) -> (word, other, other_n), each pair both ways."""
    for lot, batch, _ in in_runs(batches):
        key = batch.column(1).to_pylist()
        new = np.array([True, *[a != b for a, b in zip(key, key[1:])]])
        sizes = np.diff(np.append(np.flatnonzero(new), len(key)))
        rows = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(rows):
            continue
        some = batch.take(pa.array(rows))
        words = [w.encode("latin-1") for w in some.column(2).to_pylist()]
        n, shorter, back, at, here = (some.column(k).to_numpy(zero_copy_only=False) for k in range(3, 8))
        read = [w[::-1] if b else w for w, b in zip(words, back)]
        # Edits at one place: the letter there, if the word has one more than what it shares with the others.
        rests = [w[k:] if not h else w[k : k + 1] if len(q.split(" ", 4)[-1]) == len(w) - k - 1 else b"" for w, k, h, q in zip(read, at.tolist(), here, some.column(1).to_pylist())]
        x, y = near_words(np.cumsum(new)[rows] - 1, rests)
        keep = []
        for i, j in zip(x.tolist(), y.tolist()):
            k, a = at[i], words[i][: shorter[i] // 2] != words[j][: shorter[i] // 2]
            keep.append(min(len(words[i]), len(words[j])) == shorter[i] and (a or not back[i]) and (not here[i] or read[i][k : k + 1] != read[j][k : k + 1]))
        x, y = x[keep], y[keep]
        if len(x):
            each, other = pa.array(np.concatenate([x, y])), pa.array(np.concatenate([y, x]))
            yield pa.RecordBatch.from_arrays([some.column(2).take(each), some.column(2).take(other), some.column(3).take(other)], ["word", "other", "other_n"])


def near_pairs(words: DataFrame, least: int = 6, limit: int = LIMIT) -> DataFrame:
    """words (word, n), distinct, of ``least`` letters or more -> (word, other, other_n), both ways, words one edit apart."""
    lots = partitions(words, least, limit).repartition("lot").sortWithinPartitions("lot", "key")
    return lots.mapInArrow(tidy(joined), "word string, other string, other_n long")


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form) -> (word, root), written: where a word's forms end."""
    now = cut(forms.toDF("word", "root"), "roots")
    while True:
        onward = now.toDF("of", "next")
        step = now.join(onward, F.col("root") == F.col("of"), "left")
        next_ = cut(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not next_.where("moved").limit(1).count():
            return now
        drop(now)
        now = cut(next_.select("word", "root"), "roots")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, occurs: int = 5, factor: int = 5, noise: int | None = None, limit: int = LIMIT) -> DataFrame:
    """One row a word of ``least`` letters that occurs ``occurs`` times: word, form, root, n, n_near, form_n.

    The form is the near word of largest n (of equal ones the first in code-point order) if that is ``factor`` times the
    word's n or more. With ``noise``, runs lose letters as :func:`word_counts` states.
    """
    words = cut(word_counts(docs, id_col, text_col, least, noise).where(F.col("n") >= occurs), "words")
    pairs = near_pairs(words, least, limit)
    best = pairs.groupBy(F.col("word").alias("of")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other"))).alias("best"))
    known = words.join(best, F.col("word") == F.col("of"), "left").select("word", "n", "n_near", F.col("best.other").alias("other"), (-F.col("best.m")).alias("other_n"))
    good = F.col("other_n") >= factor * F.col("n")
    formed = cut(known.select("word", F.when(good, F.col("other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("other_n")).alias("form_n")), "forms")
    ends = roots(formed.where("form is not null").select("word", "form")).toDF("of", "root")
    out = formed.join(ends, F.col("word") == F.col("of"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
